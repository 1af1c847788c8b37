"""Readers and writers: files, exports and the stored tables."""
