"""Column expressions for codec arithmetic."""
