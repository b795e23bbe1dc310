"""Compositions of operators: full profiles, observations, quality runs."""
