"""Column functions: section selection, prompts, JSON records, rounding."""
