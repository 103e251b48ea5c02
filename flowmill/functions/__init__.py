"""Functions of the flow feature jobs."""
