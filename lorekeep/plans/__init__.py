"""Queries over the driver's tables, one for each operator or small family of them, with SQL for comparison."""
