"""Terravane: tables with geometry columns on Spark."""

__version__ = "0.2.0"
#: Filled in by whoever packages a build.
__commit__ = "none"
__date__ = "unknown"
