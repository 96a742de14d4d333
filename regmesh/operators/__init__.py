"""DataFrame -> DataFrame operators: overlap, resolve, merge, enrich, triples, metrics."""
