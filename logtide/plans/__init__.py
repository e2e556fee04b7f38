"""Composed jobs and read queries."""
