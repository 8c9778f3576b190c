"""Queries of the library's operators over the driver's tables."""
