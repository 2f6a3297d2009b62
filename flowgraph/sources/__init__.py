"""Readers and writers of analysis artifacts."""
