"""Relational operators on ordered streams and container tables."""
