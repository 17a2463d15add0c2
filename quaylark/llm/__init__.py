"""Operators of a training-data pipeline: counting, filtering, de-duplicating and mixing text."""
