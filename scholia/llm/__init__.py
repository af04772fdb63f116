"""Operators of a training-data pipeline: tokenising, scanning, scoring, dedup and mixing."""
