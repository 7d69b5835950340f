"""Complete jobs: clean, stage, enrich, load, report."""
