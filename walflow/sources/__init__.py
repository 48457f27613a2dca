"""walflow: sources."""
