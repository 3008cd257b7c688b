"""Landfold: spatial registry, terrain, mesh and evidence-audit operators on Spark."""
