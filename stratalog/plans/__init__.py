"""Durable state: run directories and the manifest that names them."""
