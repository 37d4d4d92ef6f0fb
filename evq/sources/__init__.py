"""Readers, sinks and the domain views over the sample tables."""
