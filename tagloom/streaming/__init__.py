"""Viewing images as they arrive."""
