"""Psephos: ballot analytics and data-processing operators on PySpark."""
