"""Operators on tables: manifest, audit, validate, runs, retrieval."""
