"""lakemetrics: retail and behaviour analytics, and document retrieval, on Spark."""
