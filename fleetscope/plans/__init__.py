"""Whole-scan composition, the detector registry and the query catalogue."""
