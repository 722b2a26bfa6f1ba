"""The engine's own queries, each beside SQL that gives the same rows where SQL can express it."""

from weft.queries.base import CORE
from weft.queries import fixtures, pages, search, state, text, urls  # noqa: F401  (they declare their queries)

__all__ = ["CORE"]
