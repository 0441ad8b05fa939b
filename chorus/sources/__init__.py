"""Adapters over the driver tables, file sources and sinks."""
