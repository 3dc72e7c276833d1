"""Sources of raw log records and of repository files."""
