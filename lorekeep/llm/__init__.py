"""Training-data operators. Nothing outside this package (and the top-level
``corpus_pipeline``) imports it."""
