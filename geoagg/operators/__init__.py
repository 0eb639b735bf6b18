"""Operators over points: viewports, index, grid, neighbours, greedy groups, roll-ups, summaries, GeoJSON."""
