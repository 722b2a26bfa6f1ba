"""The registry of the engine's own queries, and SQL pieces that several of them share."""

from weft.registry import Registry

CORE = Registry()


def sql_list(values) -> str:
    """SQL literals of strings, in parentheses."""
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"
