"""Catalogue operators as DataFrame jobs."""
