"""Paired-request analytics and corpus operators on Spark."""
