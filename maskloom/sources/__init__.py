"""Readers of images, exchange formats, label planes and snapshots."""
