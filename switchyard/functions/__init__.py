"""Column functions: classifiers, keys, dates and safe arithmetic."""
