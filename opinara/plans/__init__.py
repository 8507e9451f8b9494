"""Whole analyses: the query catalogue, the task registry and the report."""
