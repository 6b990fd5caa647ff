"""Wiring of operators to tables, and the SQL each of them is checked against."""
