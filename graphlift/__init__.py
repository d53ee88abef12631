"""graphlift: exact and estimated counts of labelled patterns in large labelled directed graphs, on Spark."""
