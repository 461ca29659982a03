"""Readers and writers: CSV staging, warehouse tables, result files."""
