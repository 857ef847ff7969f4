"""Whole flows made of the operators."""
