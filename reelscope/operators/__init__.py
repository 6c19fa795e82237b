"""DataFrame-to-DataFrame operators: joins, aggregations, windows, rankings, generators, frame kernels."""
