"""Calls over streams."""
