"""Operators of a training-data pipeline. Nothing else in motifloom imports them."""
