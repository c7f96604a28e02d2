"""Sources of flights and airports."""
