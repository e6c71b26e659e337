"""Operators that prepare text corpora: filtering, de-duplication, extraction and packing."""
