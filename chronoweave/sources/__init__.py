"""Readers and writers of event graphs, and the driver tables seen as one."""
