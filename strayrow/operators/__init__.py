"""Scaling, thresholds and the detectors."""
