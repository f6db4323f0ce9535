"""Column expressions without any shuffle."""
