"""Whole matching jobs."""
