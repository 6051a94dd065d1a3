"""DataFrame operators: cells, segments, caches, chunks, quality, publishing and run metrics."""
