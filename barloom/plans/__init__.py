"""Compositions: the feature table, scoring, signals, validation, backtest and reports."""
