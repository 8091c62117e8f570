"""Data-quality operators on Spark: completeness, duplicates, comparison, resolution."""
