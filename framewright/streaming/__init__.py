"""Stateful processing of ordered packets."""
