"""Labelled flow-table analytics on Spark: preparation, profiling, evaluation,
distributed fitting and streaming drift detection."""
