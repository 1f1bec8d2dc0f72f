"""Lexiloom: bilingual document QA analytics on PySpark."""
