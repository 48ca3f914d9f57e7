"""Streaming extensions; batch is the whole of the engine without them."""
