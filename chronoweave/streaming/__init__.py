"""Streams of event documents."""
