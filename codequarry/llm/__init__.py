"""Operators on prompts, answers, documents and source text for training data. Nothing outside this package imports it."""
