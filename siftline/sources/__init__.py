"""Tables of an index: build, save, load."""
