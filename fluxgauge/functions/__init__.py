"""Column-level helpers: no DataFrame, no shuffle."""
