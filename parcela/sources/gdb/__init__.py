"""The file geodatabase format: codec, tables, catalog, builder and Spark data source."""
