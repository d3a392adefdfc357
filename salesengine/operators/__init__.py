"""Operators the warehouse SQL does not have directly: histogram, top-k, bootstrap, identity, forecast."""
