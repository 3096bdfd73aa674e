"""Folds that run over a log at once or as it grows, with the same result."""
