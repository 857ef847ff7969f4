"""Scoring of tickets as they arrive."""
