"""Scripts: a small language that runs once a bar, in time order."""
