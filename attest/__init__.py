"""Cross-document verification of reported figures, as Spark jobs."""
