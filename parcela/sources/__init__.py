"""Workspaces of versioned tables, and the file geodatabase format."""
