"""Operators put together: whole feature plans, the batch job, registered queries."""
