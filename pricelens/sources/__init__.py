"""Readers and writers: daily bar trees, snapshot files and archives, event tables, driver tables."""
