"""Retail analytics operators written as Spark DataFrame transformations."""
