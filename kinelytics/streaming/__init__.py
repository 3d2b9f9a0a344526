"""Frames that arrive as files: running episode facts, and rescoring of the whole dataset for each batch.

Scores are relative to the dataset, so no score can be kept up incrementally: every batch moves the quantiles and medians.
"""
