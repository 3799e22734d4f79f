"""Listings, traffic and training-data analytics expressed as Spark DataFrame jobs."""
