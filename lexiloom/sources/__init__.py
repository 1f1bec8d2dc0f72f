"""Readers: texts and tables natively, office formats through optional parsers."""
