"""Counting plans: growth, placement sums, symmetric terms, Burnside."""
