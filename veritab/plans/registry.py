"""Registry of named queries and their oracle SQL.

A query is `run(tables) -> DataFrame`; `tables` serves the domain tables. Oracle SQL may name
any domain table `b_<name>`; the needed definitions are put in front as common table
expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.bindings import DEFINITIONS, Tables, cte_prefix

RUNNERS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_NAMED = re.compile(r"\bb_([a-z_]+)\b")


def query(name: str, oracle: str | None = None):
    """Register `run` under `name`, with SQL that must give the same rows."""

    def register(run: Callable[[Tables], DataFrame]):
        if name in RUNNERS:
            raise ValueError(f"query {name} registered twice")
        RUNNERS[name] = run
        if oracle is not None:
            ORACLES[name] = with_tables(oracle)
        return run

    return register


def with_tables(sql: str) -> str:
    """Prefix the definitions of all domain tables `sql` names."""
    names = sorted(set(_NAMED.findall(sql)) & set(DEFINITIONS))
    prefix, recursive = cte_prefix(names), False
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        recursive, body = True, body[len("WITH RECURSIVE"):].strip()
        glue = ", "
    elif body.upper().startswith("WITH "):
        body = body[len("WITH "):].strip()
        glue = ", "
    else:
        glue = " "
    if not prefix:
        return sql.strip()
    keyword = "WITH RECURSIVE " if recursive else "WITH "
    return keyword + prefix + glue + body
