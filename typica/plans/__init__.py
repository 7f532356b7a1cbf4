"""Metrics, reports, the detector facade, and the registered queries."""
