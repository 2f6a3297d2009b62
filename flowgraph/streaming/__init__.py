"""Streams of artifacts into tables, with the same operators as batches."""
