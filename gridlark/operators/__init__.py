"""Facts, dimensions, measures, filters and aggregates: what a cube is described with."""
