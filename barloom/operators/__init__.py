"""Operators on panels of bars, signals, trades, portfolios and headlines: lazy DataFrame functions."""
