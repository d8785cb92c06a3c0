"""Incremental batch runs by high watermark.  The work this library covers has no stream operators."""
