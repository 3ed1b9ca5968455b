"""DataFrame operators: intervals, islands, ranks, components and the three detectors."""
