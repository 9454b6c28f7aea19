"""Orrery: code-graph analytics and corpus operators expressed as Spark jobs."""
