"""Labelled multichannel signal trials on Spark: acquisition, splits, signals, features, evaluation."""
