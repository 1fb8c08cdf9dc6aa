"""DataFrame operators: retrieval, evaluation, stored runs, extraction, plot data."""
