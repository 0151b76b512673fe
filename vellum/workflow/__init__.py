"""Workflow graphs that become lazy plans."""
