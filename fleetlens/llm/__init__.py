"""Operators of a training-data pipeline: quality, languages, licences, near copies, leaks, tokens, archives."""
