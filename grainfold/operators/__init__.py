"""DataFrame operators: chunking, retrieval, ranking, evaluation, experiments."""
