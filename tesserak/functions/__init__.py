"""Column functions and small text helpers."""
