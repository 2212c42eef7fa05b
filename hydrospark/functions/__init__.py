"""Column functions on cells, coordinates, directions and rings."""
