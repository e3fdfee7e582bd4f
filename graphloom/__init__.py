"""graphloom: code-knowledge-graph analytics written as Spark DataFrame jobs."""
