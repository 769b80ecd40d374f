"""Retail analytics as Spark jobs: clean, aggregate, upsert, query and theme e-commerce data."""
