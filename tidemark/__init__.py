"""tidemark: member-retention analytics as Spark DataFrame operators."""
