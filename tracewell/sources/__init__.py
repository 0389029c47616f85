"""Sources: directory scans, git history, task files, and the extractors that turn files into rows."""
