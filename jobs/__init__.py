"""Runnable jobs; each module has a command line and a config file beside it."""
