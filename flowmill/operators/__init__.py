"""Operators of the flow feature jobs."""
