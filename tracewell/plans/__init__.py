"""Stored index, sessions, rendering and evaluation."""
