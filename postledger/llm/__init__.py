"""Operators that prepare training data from tables of documents and pages."""
