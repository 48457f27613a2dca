"""walflow: streaming."""
