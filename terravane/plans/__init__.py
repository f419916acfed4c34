"""Choices made while a query is built."""
