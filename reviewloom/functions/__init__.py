"""Column functions: text, scores, dates and number formats."""
