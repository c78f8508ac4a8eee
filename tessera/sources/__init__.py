"""Readers of recordings, manifests and run folders, and the sinks beside them."""
