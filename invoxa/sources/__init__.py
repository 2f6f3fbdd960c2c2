"""Sources: driver tables, derived invoice fixtures, file scans and sinks."""
