"""flowloom: network event analytics and corpus preparation as Spark jobs."""
