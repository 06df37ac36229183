"""Reading dynamic JSON (VARIANT) the way loosely typed documents are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import numeric, true


def parsed(body: Column) -> Column:
    """The body as a variant when it is a JSON object, else null."""
    value = F.try_parse_json(body)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def with_keys(df: DataFrame, root: str, keys: list[str]) -> DataFrame:
    """Add value and kind of the given keys as columns, so each is read once per row."""
    valued = df.withColumns({f"v_{k}": F.try_variant_get(F.col(root), f"$.{k}", "variant") for k in keys})
    return valued.withColumns({f"k_{k}": F.schema_of_variant(F.col(f"v_{k}")) for k in keys})


class Node:
    """One value of a parsed document: its kind, text, number and truth."""

    def __init__(self, key: str):
        """A top-level key laid out by `with_keys`."""
        self.value, self.kind = F.col(f"v_{key}"), F.col(f"k_{key}")

    def given(self) -> Column:
        """Present and not null."""
        return true(self.kind != "VOID")

    def defined(self) -> Column:
        """Present, perhaps null."""
        return self.kind.isNotNull()

    def is_text(self) -> Column:
        return true(self.kind == "STRING")

    def is_number(self) -> Column:
        return true(self.kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))

    def text(self) -> Column:
        """The string, or null when the value is of another kind."""
        return F.when(self.is_text(), self.as_text())

    def as_text(self) -> Column:
        return F.try_variant_get(self.value, "$", "string")

    def number(self) -> Column:
        return F.when(self.is_number(), F.try_variant_get(self.value, "$", "double"))

    def number_or_text(self) -> Column:
        """A number, or a string that spells one. An empty string is no number here."""
        return F.coalesce(self.number(), numeric(self.text()))

    def coerced(self) -> Column:
        """Number a loosely typed reader would see: null counts 0 and truth values 1 or 0."""
        return (
            F.when(self.kind == "VOID", F.lit(0.0))
            .when(self.kind == "BOOLEAN", self.flag().cast("double"))
            .otherwise(self.number_or_text())
        )

    def flag(self) -> Column:
        return F.when(self.kind == "BOOLEAN", F.try_variant_get(self.value, "$", "boolean"))

    def is_true(self) -> Column:
        return true(self.flag())

    def is_false(self) -> Column:
        return true(~self.flag())

    def truthy(self) -> Column:
        """False for absent, null, false, 0 and the empty string; true otherwise."""
        return true(
            F.when(self.kind == "VOID", False).when(self.kind == "BOOLEAN", self.flag())
            .when(self.kind == "STRING", F.length(self.as_text()) > 0)
            .when(self.is_number(), self.number() != 0)
            .otherwise(self.kind.isNotNull())
        )

    @classmethod
    def of(cls, value: Column) -> Node:
        """Any variant expression."""
        node = cls.__new__(cls)
        node.value, node.kind = value, F.schema_of_variant(value)
        return node

    def child(self, key: str) -> Node:
        return Node.of(F.try_variant_get(self.value, f"$.{key}", "variant"))


def either(first: Node, second: Node) -> Node:
    """The first value unless it is absent or null."""
    return Node.of(F.when(first.given(), first.value).otherwise(second.value))
