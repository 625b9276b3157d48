"""commentflow: comment triage for issue trackers and forums as Spark jobs."""
