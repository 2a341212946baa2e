"""The same windows and detectors over unbounded packet streams."""
