"""Operator 5: lines that many documents share.

Lines are normalised, hashed and exploded once per document; hashes are counted over documents;
hashes over the threshold go back to the documents that hold them, and each document's lines are
filtered in place, so that line texts never travel. A hash is 64 bits: a wrong drop needs a line
to collide with one of the few frequent lines, not with any line.

Defined results: null or empty text is one empty line; a line that is empty after stripping is
never dropped while `min_chars` is at least 1; every row counts as a document, so rows that repeat
a doc_id count once each and lose the same lines; a null doc_id is an id like any other; an empty
table gives no rows; other columns are passed through by `drop_common_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import keeps_columns
from .registry import query, table
from .text import LOWER, UPPER

MIN_DOCS = 10
MIN_CHARS = 1
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def mark_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` with __n_lines, __n_dropped and __kept, the text without lines that `min_docs` documents share."""
    if min_chars < 1:
        raise ValueError("min_chars must be at least 1: empty lines only shape a text")
    long_enough = lambda line: F.char_length(line_key(line)) >= min_chars
    hashed = lambda line: F.xxhash64(line_key(line))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), long_enough), hashed))
    held = docs.select(F.col("doc_id").alias("__id"), F.explode(keys).alias("__line"))
    common = held.groupBy("__line").agg(F.count(F.lit(1)).alias("__docs")).filter(F.col("__docs") >= min_docs)
    # joined on another form of the key: both sides are shuffled for the join, so that Spark can split a hot line
    key = F.bitwise_not("__line")
    met = held.withColumn("__key", key).join(common.select(key.alias("__key")), "__key")
    drops = met.groupBy("__id").agg(F.collect_set("__line").alias("__drop"))
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops["__id"]), "left")
    stays = lambda line: ~(long_enough(line) & F.array_contains("__drop", hashed(line)))
    lines = _lines(F.col("text"))
    kept = F.when(F.col("__drop").isNull(), lines).otherwise(F.filter(lines, stays))
    counted = joined.withColumn("__lines", kept)
    return counted.select(
        *[docs[c] for c in docs.columns],
        F.size(lines).cast("long").alias("__n_lines"),
        (F.size(lines) - F.size("__lines")).cast("long").alias("__n_dropped"),
        F.array_join("__lines", "\n").alias("__kept"),
    )


@keeps_columns
def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The same documents and columns with the lines gone from `text`, and `n_chars` (if there) counted anew."""
    marked = mark_common_lines(docs, min_docs, min_chars)
    changed = F.col("__n_dropped") > 0
    new = {
        "text": F.when(changed, F.col("__kept")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.char_length("__kept").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None,
    }
    return marked.select(*[new[c].alias(c) if new.get(c) is not None else F.col(c) for c in docs.columns])


@query(
    "op5_line_dedup",
    rf"""
    WITH lines AS (
        SELECT rowid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
        FROM (SELECT row_number() OVER () AS rowid, * FROM documents)
    ), keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
        FROM lines
    ), common AS (
        SELECT key FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT rowid) >= {MIN_DOCS}
    )
    SELECT any_value(k.doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
           sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.place) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
    FROM keyed k LEFT JOIN common c ON k.key = c.key
    GROUP BY k.rowid
    """,
)
def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    marked = mark_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )
