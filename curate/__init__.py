"""A Spark engine for imbalanced labelled text and for judging its classifiers."""
