"""Ledgerloom: statement, reconciliation, surveillance and retrieval analytics as Spark jobs."""
