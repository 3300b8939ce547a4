"""Governed knowledge retrieval and its bookkeeping as Spark jobs."""
