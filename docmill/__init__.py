"""docmill: schema-governed JSON document analytics, compiled to Spark DataFrames."""
