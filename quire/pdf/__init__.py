"""Kernels that read and write PDF bytes; one document at a time, no Spark."""
