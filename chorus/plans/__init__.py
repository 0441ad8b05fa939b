"""Named queries over the driver tables, each with its SQL oracle where one exists."""

from .catalog import REGISTRY, oracle_sql, queries  # noqa: F401
