"""kinelake: multi-rate trajectory analytics expressed as Spark DataFrame, SQL and streaming operators."""
