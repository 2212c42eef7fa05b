"""Operators: map algebra, stencils, flow graphs, slope surfaces, geometry and basin division."""
