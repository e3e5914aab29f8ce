"""Spark jobs that analyse captured SQL workloads."""
