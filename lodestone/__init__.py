"""Search and analytics over DataFrames: fields, a composable query tree, aggregations, fusion and ingestion."""
