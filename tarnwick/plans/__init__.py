"""Whole plans: the daily build, the backtest, and the driver's queries."""
