"""Sources: tables, JDBC, GeoJSON, XML features, GraphQL results; schema inference and validation."""
