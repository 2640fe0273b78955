"""Column-level building blocks (Column -> Column), all native Spark SQL
expressions so they stay inside whole-stage codegen."""
