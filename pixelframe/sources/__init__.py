"""Readers and writers of frames, timestamps and series."""
