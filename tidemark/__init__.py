"""tidemark: alignment analytics and large-table operators as Spark DataFrame jobs."""
