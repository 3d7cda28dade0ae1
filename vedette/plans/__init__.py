"""Composite jobs: operators chained into one lazy plan."""
