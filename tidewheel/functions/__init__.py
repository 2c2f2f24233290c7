"""Registered functions."""
