"""Phrase segmentation of one parsed sentence: plain Python on token columns, wrapped for Arrow in ``udf``."""
