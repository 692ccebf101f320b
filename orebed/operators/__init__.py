"""Operators of the orebed engine."""
