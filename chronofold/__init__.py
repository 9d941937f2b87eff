"""Bitemporal analytics on Spark: declarative plans over append-only facts."""
