"""Operators of a text-corpus pipeline: fingerprints, scans, filters, scores, encoding, packing."""
