"""Point streams: appends to a stored dataset and running cell counts."""
