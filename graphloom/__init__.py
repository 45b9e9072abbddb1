"""graphloom: corpus analytics, graph building and hybrid retrieval as Spark DataFrame transforms."""
