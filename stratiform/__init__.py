"""Soft, multi-level hierarchies of knowledge cards, and corpus preparation, on PySpark."""
