"""Operators on tracer catalogues, meshes, graphs and tessellations."""
