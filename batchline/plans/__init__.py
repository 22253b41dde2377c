"""Parameterised transforms and the scheduling plan."""
