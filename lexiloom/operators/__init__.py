"""Relational operators of document quality assurance, one module per phase."""
