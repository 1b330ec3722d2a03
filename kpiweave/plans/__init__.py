"""Versioned tables and the jobs that load, keep and report on them."""
