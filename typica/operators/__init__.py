"""Distributed operators: neighbours, topology features, linear statistics, densities, detectors."""
