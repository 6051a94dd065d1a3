"""Micro-batch jobs, feedback controllers and event metrics over streams."""
