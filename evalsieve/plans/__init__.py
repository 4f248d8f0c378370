"""Report tables, and whole jobs from files to files."""
