"""Columns of the caller beside an operator's own."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame


def keeps_columns(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Operators name their working columns `__...`; columns of the input with such names are renamed meanwhile."""

    @wraps(run)
    def shielded(docs: DataFrame, *args, **kwargs) -> DataFrame:
        ours = [c for c in docs.columns if c.startswith("__")]
        taken = {c.lower() for c in docs.columns}
        names = (n for k in range(len(docs.columns) + len(ours)) if (n := f"held_{k}") not in taken)
        held = dict(zip(ours, names))
        if not held:
            return run(docs, *args, **kwargs)
        out = run(docs.withColumnsRenamed(held), *args, **kwargs)
        return out.withColumnsRenamed({new: old for old, new in held.items()})

    return shielded
