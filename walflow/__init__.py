"""walflow: change-data-capture analytics on plain PySpark."""
