"""Operators: DataFrame in, DataFrame out. ``keys`` name the series; windows never run without them."""
