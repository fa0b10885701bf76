"""Whole runs, and what they need from the session."""
