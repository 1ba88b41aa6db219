"""Cohort association analysis as Spark jobs."""
