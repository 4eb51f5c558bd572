"""Column functions: text, scores, gates, statistics."""
