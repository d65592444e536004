"""Framewright: media streams as Spark tables, processed with DataFrame operators."""
