"""Sources of the flow feature jobs."""
