"""Readers that turn a job source into a DataFrame, and the landing writer."""
