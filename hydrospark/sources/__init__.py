"""Sources and sinks: cell tables, tile catalogs, GeoJSON, text records and test fixtures."""
