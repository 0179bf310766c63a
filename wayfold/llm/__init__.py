"""Operators of a training-data pipeline: dedup, decontamination, scoring, packing, counting."""
