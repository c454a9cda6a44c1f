"""Framed-message journals and scan analytics on PySpark."""
