"""Incremental work over growing corpora."""
