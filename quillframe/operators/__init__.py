"""Relational operators that Spark lacks in this form."""
