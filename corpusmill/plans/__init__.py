"""Query catalogue and the corpus pipeline."""
