"""Training-data operators: ten corpus operators that stand apart from the market engine."""
