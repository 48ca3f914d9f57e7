"""Batch analytics over many multi-channel series, as DataFrame transforms."""
