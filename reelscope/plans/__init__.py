"""Multi-step analyses assembled from the operators: prediction, gates, ladders, planning, reports."""
