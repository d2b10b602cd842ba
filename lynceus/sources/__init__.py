"""Readers, adapters, profiling and sinks."""
