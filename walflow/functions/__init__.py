"""walflow: functions."""
