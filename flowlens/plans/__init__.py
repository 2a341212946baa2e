"""Whole jobs: configuration, batch runs, user-written detectors."""
