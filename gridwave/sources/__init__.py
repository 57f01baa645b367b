"""Inputs (fact tables, grids, coins, start states) and text/metric sinks."""
