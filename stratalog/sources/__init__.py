"""Readers and writers of the binary log, table and write-ahead formats."""
