"""Operators that prepare text corpora for training: deduplication, filtering, scanning, tokenising and storing."""
