"""Text scans, sinks and keyed tables."""
