"""Versioned code and scene graphs on Spark: search, resolution, neighbourhoods, diffs, lineage and data quality."""
