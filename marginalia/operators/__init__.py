"""Jobs over tables: extraction, joins, ranking, measures, graph, quality."""
