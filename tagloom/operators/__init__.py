"""Viewing and editing whole collections of images."""
