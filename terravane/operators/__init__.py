"""What the engine does with tables: extract, convert, stats, describe, validate."""
