"""Relational operators: ordered slices, windows, histograms, texts, runs."""
