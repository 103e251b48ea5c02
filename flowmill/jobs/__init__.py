"""Jobs of the flow feature library."""
