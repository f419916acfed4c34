"""Geometry codec, column functions and boxes."""
