"""DataFrame operators: history features, vocabulary, datasets, metrics, selection, review."""
