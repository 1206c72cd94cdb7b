"""Set operations over feeds, episodes and the library."""
