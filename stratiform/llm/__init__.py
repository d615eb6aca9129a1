"""Preparation of training text: ten corpus operators and their queries."""
