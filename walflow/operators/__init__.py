"""walflow: operators."""
