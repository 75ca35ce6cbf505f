"""Connected components of a link table, as the core library computes them."""

from confluo.operators.graph import connected

__all__ = ["connected"]
