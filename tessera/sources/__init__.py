"""Readers: capture snapshots, static HTML, images."""
