"""Global sensitivity analysis as Spark jobs."""
