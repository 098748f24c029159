"""Readers and writers of the logs' file formats."""
