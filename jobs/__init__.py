"""Runnable jobs: each has a command line and a configuration file of the same name."""
