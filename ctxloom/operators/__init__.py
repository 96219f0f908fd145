"""Operators over DataFrames: context statistics, folds, joins in time, cleanup, metrics, guards, models."""
