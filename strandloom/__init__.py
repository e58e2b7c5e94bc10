"""Aligned-read analytics on Spark: declarative DataFrame plans over packed reads."""
