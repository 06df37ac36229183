"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import NUMERIC_TEXT


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def ident(*parts: Column | str) -> Column:
    """Join parts with ':' into an id; plain strings are literals."""
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def digest(text: Column) -> Column:
    """Content digest of UTF-8 text, 0x-prefixed."""
    return F.concat(F.lit("0x"), F.sha2(text, 256))


def digest_bytes(text: Column) -> Column:
    """The 32 bytes of a digest's text, half as long to move; null for any other text."""
    return F.when(text.rlike(r"^0x[0-9a-f]{64}\z"), F.unhex(text.substr(3, 64)))


def digest_text(content: Column) -> Column:
    """The text of a digest's bytes."""
    return F.concat(F.lit("0x"), F.lower(F.hex(content)))


def packed(text: Column) -> Column:
    """A text in fewer bytes, the same only for the same text: lower-case hex behind 0x as its bytes, any other text as it is."""
    hexed = text.rlike(r"^0x[0-9a-f]+\z") & (F.length(text) % 2 == 0)
    return F.when(hexed, F.concat(F.unhex(F.lit("00")), F.unhex(text.substr(F.lit(3), F.length(text))))).otherwise(
        F.concat(F.unhex(F.lit("01")), text.cast("binary"))
    )


def isin(column: Column, values: Iterable) -> Column:
    """Membership that is false, not null, for null."""
    return F.coalesce(column.isin(list(values)), F.lit(False))


def true(condition: Column) -> Column:
    """The condition, with null read as false."""
    return F.coalesce(condition, F.lit(False))


def blank(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(0)) == 0


def trimmed(text: Column) -> Column:
    """Strip white space of any kind from both ends."""
    return F.regexp_replace(text, r"^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$", "")


def folded(text: Column) -> Column:
    """Form in which two texts count as the same value."""
    return F.lower(trimmed(text))


def numeric(text: Column) -> Column:
    """Number written in a text, or null."""
    return F.when(text.rlike(NUMERIC_TEXT), trimmed(text).try_cast("double"))


def rank_of(column: Column, order: list[str]) -> Column:
    """Position of a value in an order of precedence (1 = first), null when absent."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), column)
    return F.when(pos > 0, pos)


def by_rank(rank: Column, order: list[str]) -> Column:
    """Value at a position of an order of precedence."""
    return F.get(F.array(*[F.lit(v) for v in order]), (rank - 1).cast("int"))


def fan_out(*rows: Column) -> Column:
    """Explode the non-null structs among `rows`."""
    return F.explode(F.array_compact(F.array(*rows)))
