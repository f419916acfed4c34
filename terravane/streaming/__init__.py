"""Stateless operators over files as they arrive."""
