"""Scoring arriving rows."""
