"""Column-level functions: tokens, names, paths and scores."""
