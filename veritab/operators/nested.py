"""Conformance of nested JSON documents: every part at every depth, as violation rows with their path.

A schema is a tree of `Record`, `Items` and leaves, and a document is walked along it: a record reads its keys
once, a list is walked item by item, a leaf tests its value. Each document is parsed once and each value seen
once; a document stays one row, nothing is joined or shuffled, and one row per broken rule leaves. Whether text
is JSON at all is asked of Spark's parser.

Defined results: text that is no JSON gives `not_json` at `$`; a value of the wrong kind gives `type`
at its path and nothing below it; an optional key may be missing but not null; a key that the schema does
not know gives `unknown_key` at its path; free JSON parts are not looked into.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed as X

ROOT = "$"
# numbers are compared as doubles; text after the first value is not read, as Spark's parser does
_DECODER = json.JSONDecoder(parse_int=float)
_LEAST, _MOST = -(2.0**63), 2.0**63


@dataclass(frozen=True)
class Text:
    """A string; not empty, one of `among`, or like `pattern`, where these are given."""

    filled: bool = True
    among: tuple[str, ...] | None = None
    pattern: str | None = None


@dataclass(frozen=True)
class Number:
    low: float
    high: float | None = None
    whole: bool = False


@dataclass(frozen=True)
class Free:
    """Any JSON; an object only, if asked for."""

    only_object: bool = False


@dataclass(frozen=True)
class Items:
    of: Node


@dataclass(frozen=True)
class Record:
    required: dict[str, Node]
    optional: dict[str, Node] = field(default_factory=dict)

    def fields(self) -> dict[str, Node]:
        return {**self.required, **self.optional}


Node = Text | Number | Free | Items | Record


def low_rule(node: Number) -> str:
    return f"at_least_{node.low:g}"


@lru_cache
def _pattern(pattern: str) -> re.Pattern:
    """A pattern whose closing `$` stands, as in Spark, before any last line break."""
    return re.compile(pattern[:-1] + r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)" if pattern.endswith("$") else pattern)


def _text_rules(node: Text, text: str) -> str | None:
    if node.among is not None:
        return None if text in node.among else "member"
    if node.pattern is not None:
        return None if _pattern(node.pattern).search(text) else "pattern"
    return "non_empty" if node.filled and text == "" else None


def _number_rules(node: Number, number: float) -> Iterator[str]:
    if node.high is not None:
        if number < node.low or number > node.high:
            yield "range"
    elif number < node.low:
        yield low_rule(node)
    # whole numbers are those of 64 bits
    if node.whole and not (_LEAST <= number <= _MOST and number == math.floor(number)):
        yield "whole"


def check(node: Node, value: object, path: str) -> Iterator[tuple[str, str]]:
    """(rule, path) of every rule that a present value breaks."""
    if isinstance(node, Record):
        if not isinstance(value, dict):
            yield "type", path
            return
        known = node.fields()
        for key in value:
            if key not in known:
                yield "unknown_key", f"{path}.{key}"
        for key, child in known.items():
            if key in value:
                yield from check(child, value[key], f"{path}.{key}")
            elif key in node.required:
                yield "required", f"{path}.{key}"
    elif isinstance(node, Items):
        if not isinstance(value, list):
            yield "type", path
            return
        for i, item in enumerate(value):
            yield from check(node.of, item, f"{path}[{i}]")
    elif isinstance(node, Text):
        if not isinstance(value, str):
            yield "type", path
        elif rule := _text_rules(node, value):
            yield rule, path
    elif isinstance(node, Number):
        if not isinstance(value, float):
            yield "type", path
        else:
            for rule in _number_rules(node, value):
                yield rule, path
    elif node.only_object and not isinstance(value, dict):
        yield "type", path


def document_violations(schema: Node, text: bytes) -> Iterator[tuple[str, str]]:
    """(rule, path) of every rule that a document breaks."""
    return check(schema, _DECODER.raw_decode(text.decode("utf-8", "replace").lstrip())[0], ROOT)


def violations(documents: DataFrame, row_id: str, json: str, schema: Node) -> DataFrame:
    """(row_id, rule, path), one row for each place where a document breaks a rule."""
    rows = documents.select(
        F.col(row_id).alias("row_id"), F.when(F.try_parse_json(F.col(json)).isNotNull(), F.col(json)).alias("document")
    )
    kind = rows.schema["row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rules, paths = [], [], []
            for i, document in enumerate(batch.column(1)):
                found = document_violations(schema, document.as_buffer().to_pybytes()) if document.is_valid else [("not_json", ROOT)]
                for rule, path in found:
                    at.append(i)
                    rules.append(rule)
                    # a lone surrogate in a key has no UTF-8
                    paths.append(path.encode("utf-8", "replace"))
            columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(rules, pa.string()), pa.array(paths, pa.binary()).cast(pa.string())]
            yield pa.record_batch(columns, names=["row_id", "rule", "path"])

    return rows.mapInArrow(run, f"row_id {kind}, rule string, path string")


def places(node: Node, path: str = ROOT) -> Iterator[tuple[str, Node]]:
    """Every place of a schema; list items are written `[]`."""
    yield path, node
    if isinstance(node, Items):
        yield from places(node.of, f"{path}[]")
    elif isinstance(node, Record):
        for key, child in node.fields().items():
            yield from places(child, f"{path}.{key}")


def among(values: list[str]) -> Text:
    return Text(among=tuple(values))


# --- fixed values: the parts of an object document ------------------------------------
REF, TEXT, HEX = Text(), Text(filled=False), Text(pattern=X.HEX)
REFS, MILLIS, UNIT = Items(REF), Number(0, whole=True), Number(0, 1)
IDENTIFIER = Record(
    {"scheme": among(X.IDENTIFIER_SCHEMES), "value": REF, "source": REF, "status": among(X.CLAIM_STATES)}, {"namespace": TEXT}
)
CLASSIFICATION = Record({"primary": REF, "secondary": Items(TEXT), "confidence": UNIT, "claimRef": REF})
REPRESENTATION = Record(
    {
        "id": REF, "environment": among(X.ENVIRONMENTS), "identifiers": Items(IDENTIFIER), "relationshipToObject": REF,
        "status": among(X.REPRESENTATION_STATUSES), "evidence": REFS,
    },
    {"network": TEXT, "contract": TEXT, "tokenStandard": TEXT},
)
RELATIONSHIP = Record(
    {
        "id": REF, "subject": REF, "predicate": among(X.PREDICATES), "object": REF, "state": among(X.CLAIM_STATES),
        "evidence": REFS, "attestations": REFS,
    },
    {"inferredBy": REF, "confidence": UNIT, "observedAt": MILLIS, "validFrom": MILLIS, "validUntil": MILLIS},
)
CLAIM = Record(
    {
        "id": REF, "subject": REF, "property": REF, "value": Free(), "state": among(X.CLAIM_STATES),
        "sourceRefs": REFS, "evidenceRefs": REFS, "attestationRefs": REFS, "createdAt": MILLIS,
    },
    {"unit": TEXT, "confidence": UNIT, "observedAt": MILLIS, "validFrom": MILLIS, "expiresAt": MILLIS, "supersedes": REF},
)
EVIDENCE = Record(
    {
        "id": REF, "type": among(X.EVIDENCE_TYPES), "source": REF, "contentHash": HEX, "observedAt": MILLIS,
        "fetchedAt": MILLIS, "authority": among(X.EVIDENCE_AUTHORITIES), "metadata": Free(only_object=True),
    },
    {"locator": TEXT, "freshness": among(X.FRESHNESS)},
)
ATTESTATION = Record(
    {
        "id": REF, "subject": REF, "claimRef": REF, "schema": REF, "attestor": REF, "signature": HEX,
        "issuedAt": MILLIS, "state": among(X.ATTESTATION_STATES),
    },
    {"evidenceRoot": HEX, "expiresAt": MILLIS, "revokedAt": MILLIS},
)
PARTY = Record({"id": REF, "role": REF, "name": REF, "identifiers": Items(IDENTIFIER), "claimRefs": REFS})
TERMS = {"id": REF, "type": REF, "terms": Free(only_object=True), "claimRefs": REFS}
RESTRICTION = Record({"id": REF, "type": REF, "scope": REF, "claimRefs": REFS, "evidenceRefs": REFS})
ECONOMICS = Record({"asOf": MILLIS, "values": Free(only_object=True), "claimRefs": REFS})
EDGE = Record({"id": REF, "from": REF, "to": REF, "relation": REF})
EXCEPTION = Record(
    {
        "id": REF, "objectId": REF, "type": among(X.EXCEPTION_TYPES), "severity": among(X.SEVERITIES), "affectedClaims": REFS,
        "evidence": REFS, "detectedAt": MILLIS, "status": among(X.EXCEPTION_STATUSES),
    },
    {"resolutionOptions": Items(TEXT)},
)
CHECK = Record(
    {"id": REF, "type": REF, "subject": REF, "result": among(X.OUTCOMES), "evidence": REFS, "ruleVersion": REF, "timestamp": MILLIS},
    {"reason": TEXT},
)
VERIFICATION = Record(
    {"status": among(X.OUTCOMES), "verifierVersion": REF, "checks": Items(CHECK)}, {"objectRoot": HEX, "evidenceRoot": HEX}
)
OBJECT = Record({
    "id": REF, "version": Number(1, whole=True), "classification": CLASSIFICATION, "identifiers": Items(IDENTIFIER),
    "representations": Items(REPRESENTATION), "relationships": Items(RELATIONSHIP), "parties": Items(PARTY),
    "rights": Items(Record(TERMS, {"holder": REF})), "obligations": Items(Record(TERMS, {"obligor": REF})),
    "restrictions": Items(RESTRICTION), "economics": ECONOMICS, "claims": Items(CLAIM), "evidence": Items(EVIDENCE),
    "attestations": Items(ATTESTATION), "exceptions": Items(EXCEPTION), "provenance": Record({"edges": Items(EDGE)}),
    "status": among(X.OBJECT_STATES), "verification": VERIFICATION,
})


def object_violations(documents: DataFrame) -> DataFrame:
    """Violations of object documents (object_id, json) in all their nested parts."""
    return violations(documents, "object_id", "json", OBJECT)
