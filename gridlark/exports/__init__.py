"""What leaves the engine: grids as CSV, JSON and HTML, facts, configurations, snapshots."""
