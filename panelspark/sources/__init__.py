"""Sources of the panel library."""
