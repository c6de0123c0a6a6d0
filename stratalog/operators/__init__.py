"""Operators over mutation logs, sorted runs and ordered sets."""
