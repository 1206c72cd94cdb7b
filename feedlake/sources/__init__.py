"""Scans of landed feed payloads."""
