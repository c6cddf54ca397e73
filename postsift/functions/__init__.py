"""Column functions: text, time, priorities, model answers, PDF text."""
