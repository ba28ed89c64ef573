"""DataFrame operators: index, ranking, fusion, selection, graph."""
