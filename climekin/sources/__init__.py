"""Point tables and generators."""
