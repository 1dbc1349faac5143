"""Scans, catalogue, dimension checks and sinks."""
