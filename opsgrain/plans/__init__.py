"""Inputs from the tables at hand, and a query with SQL for each operator."""
