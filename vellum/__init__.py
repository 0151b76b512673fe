"""Vellum: document analytics as lazy Spark plans."""
