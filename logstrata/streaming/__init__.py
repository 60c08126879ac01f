"""The same folds as streams."""
