"""Statistics, severity, detectors, joins, flows, time series and search as DataFrame operators."""
