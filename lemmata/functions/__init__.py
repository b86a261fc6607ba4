"""Expressions and aggregate functions that rules are written with."""
