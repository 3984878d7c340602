"""lorekeep: document-memory retrieval and knowledge-lifecycle analytics on Spark."""
