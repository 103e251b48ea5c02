"""Streaming of the flow feature jobs."""
