"""Queries over the driver tables, one module per family, each with its SQL check."""
