"""walflow: plans."""
