"""Domain tables derived from the shared test tables.

Each definition is SQL that Spark and DuckDB both run; the dialect object covers the few
spellings that differ. No binding drops rows to make a branch: a missing reference is a row
that names something which does not exist.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..fixed import NOW_MS

RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

SPREAD = ("lineitem", "orders", "documents")


class SparkDialect:
    @staticmethod
    def raw(name: str) -> str:
        return "{" + name + "}"

    @staticmethod
    def arr(*items: str) -> str:
        return f"array({', '.join(items)})"

    @staticmethod
    def each(*items: str) -> str:
        """One row per item."""
        return f"explode(array({', '.join(items)}))"

    @staticmethod
    def empty() -> str:
        return "CAST(array() AS ARRAY<STRING>)"

    @staticmethod
    def sha(text: str) -> str:
        return f"sha2({text}, 256)"

    @staticmethod
    def ms(column: str) -> str:
        return f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})"

    @staticmethod
    def clean(text: str) -> str:
        return f"regexp_replace({text}, r'[\"\\\\\\x00-\\x1f]', ' ')"

    @staticmethod
    def words(text: str) -> str:
        return f"size(split({text}, ' '))"


class DuckDialect:
    @staticmethod
    def raw(name: str) -> str:
        return name

    @staticmethod
    def arr(*items: str) -> str:
        return f"list_value({', '.join(items)})"

    @staticmethod
    def each(*items: str) -> str:
        return f"unnest(list_value({', '.join(items)}))"

    @staticmethod
    def empty() -> str:
        return "CAST([] AS VARCHAR[])"

    @staticmethod
    def sha(text: str) -> str:
        return f"sha256({text})"

    @staticmethod
    def ms(column: str) -> str:
        return f"(epoch_us({column}) // 1000)"

    @staticmethod
    def clean(text: str) -> str:
        return f"regexp_replace({text}, '[\"\\\\\\x00-\\x1f]', ' ', 'g')"

    @staticmethod
    def words(text: str) -> str:
        return f"len(string_split({text}, ' '))"


def _line_key() -> str:
    return (
        "CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || ':' || "
        "CAST(l_partkey AS STRING) || ':' || CAST(l_suppkey AS STRING) || ':' || "
        "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)"
    )


def objects(d) -> str:
    return f"""
    SELECT 'object:' || CAST(o_orderkey AS STRING) AS object_id, 1 AS version,
           o_orderpriority AS primary_class, {d.arr('o_orderstatus')} AS secondary,
           CAST(1.0 AS DOUBLE) AS confidence,
           'claim:class:' || CAST(o_orderkey AS STRING) AS claim_ref,
           {d.ms('o_orderdate')} AS created_at, {d.ms('o_orderdate')} + 86400000 AS updated_at
    FROM {d.raw('orders')}"""


def snapshots(d) -> str:
    return f"""
    SELECT 'snap:' || CAST(s_suppkey AS STRING) AS snapshot_id,
           'nation:' || CAST(s_nationkey AS STRING) AS source_id,
           CASE WHEN s_suppkey % 19 = 7 THEN 'not a url'
                ELSE 'https://source.example/' || CAST(s_suppkey AS STRING) END AS uri,
           CASE WHEN s_suppkey % 29 = 11 THEN '' ELSE 'application/json' END AS content_type,
           CASE WHEN s_suppkey % 13 = 5 THEN '0x'
                ELSE '0x' || {d.sha("'body of snap:' || CAST(s_suppkey AS STRING)")} END AS content_hash,
           CASE WHEN s_suppkey % 23 = 9 THEN {NOW_MS} + 1000
                ELSE {NOW_MS} - s_suppkey * 86400000 END AS fetched_at,
           CASE WHEN s_suppkey % 11 = 0 THEN 503 WHEN s_suppkey % 3 = 0 THEN NULL ELSE 200 END AS http_status,
           CASE WHEN s_suppkey % 17 = 6 THEN '   '
                ELSE 'storage:' || CAST(s_suppkey AS STRING) END AS body_storage_ref,
           CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'v2' END AS extraction_version,
           {NOW_MS} - s_suppkey * 90000000 AS observed_at,
           CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(300 AS BIGINT) * 86400000 END AS max_age_ms,
           CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'line:' || CAST(s_suppkey AS STRING) END AS locator,
           s_name AS note
    FROM {d.raw('supplier')}"""


def evidence(d) -> str:
    key = _line_key()
    return f"""
    SELECT 'evidence:' || {key} AS evidence_id,
           'object:' || CAST(l_orderkey AS STRING) AS object_id,
           CASE l_linenumber WHEN 1 THEN 'DOCUMENT' WHEN 2 THEN 'ORACLE' WHEN 3 THEN 'ONCHAIN_STATE'
                WHEN 4 THEN 'ATTESTATION' WHEN 5 THEN 'API_RESPONSE' WHEN 6 THEN 'FILING'
                ELSE 'PROOF' END AS type,
           CASE WHEN l_suppkey % 17 = 3 THEN 'snap:gone:' || CAST(l_suppkey AS STRING)
                WHEN l_suppkey % 17 = 8 THEN 'nation:' || CAST(l_suppkey % 25 AS STRING)
                ELSE 'snap:' || CAST(l_suppkey AS STRING) END AS source,
           CASE WHEN l_partkey % 211 = 0 THEN '0xbad'
                WHEN l_partkey % 31 = 0 THEN '0x' || {d.sha("'other body of ' || CAST(l_partkey AS STRING)")}
                ELSE '0x' || {d.sha("'body of snap:' || CAST(l_suppkey AS STRING)")} END AS content_hash,
           CASE WHEN l_linenumber % 2 = 0 THEN 'line:' || CAST(l_linenumber AS STRING) ELSE NULL END AS locator,
           {d.ms('l_shipdate')} AS observed_at,
           {d.ms('l_shipdate')} + 3600000 AS fetched_at,
           CASE l_suppkey % 9 WHEN 0 THEN 'PRIMARY_SOURCE' WHEN 1 THEN 'AUTHORIZED_ATTESTOR'
                WHEN 2 THEN 'ONCHAIN_STATE' WHEN 3 THEN 'INDEPENDENT_ORACLE' WHEN 4 THEN 'REFERENCE_DATA'
                WHEN 5 THEN 'MARKET_DATA' WHEN 6 THEN 'DERIVED' WHEN 7 THEN 'AI_INFERENCE'
                ELSE 'DEMO_FIXTURE' END AS authority,
           CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'STALE'
                WHEN l_returnflag = 'A' THEN 'FRESH' ELSE NULL END AS freshness,
           '{{"line":' || CAST(l_linenumber AS STRING) || ',"part":' || CAST(l_partkey AS STRING) || '}}'
               AS metadata_json
    FROM {d.raw('lineitem')}
    UNION ALL
    SELECT 'evidence:order:' || CAST(o_orderkey AS STRING), 'object:' || CAST(o_orderkey AS STRING),
           'OTHER', 'nation:' || CAST(o_custkey % 25 AS STRING),
           '0x' || {d.sha("'order ' || CAST(o_orderkey AS STRING)")}, NULL,
           {d.ms('o_orderdate')}, {d.ms('o_orderdate')}, 'PRIMARY_SOURCE', 'FRESH', '{{}}'
    FROM {d.raw('orders')}"""


def _keyed_lines(d, *kinds: str) -> str:
    """Line items with their key, once per kind, from one scan."""
    return f"(SELECT *, {_line_key()} AS k, {d.each(*kinds)} AS kind FROM {d.raw('lineitem')}) lines"


def claims(d) -> str:
    own = "'evidence:' || k"
    return f"""
    SELECT 'claim:' || k || ':' || kind AS claim_id,
           'object:' || CAST(l_orderkey AS STRING) AS object_id, 'object:' || CAST(l_orderkey AS STRING) AS subject,
           CASE kind WHEN 'nav' THEN 'nav' WHEN 'yield' THEN 'yieldBps' ELSE 'shareClass' END AS property,
           CASE kind WHEN 'class' THEN 'string' ELSE 'number' END AS value_kind,
           CASE kind WHEN 'nav' THEN CAST(round(l_extendedprice * 100) AS BIGINT) / CAST(l_quantity * 100 AS BIGINT)
                     WHEN 'yield' THEN round(l_discount * 10000) ELSE NULL END AS value_num,
           CASE WHEN kind <> 'class' THEN NULL WHEN l_linenumber % 2 = 0 THEN ' ' || l_returnflag
                ELSE lower(l_returnflag) END AS value_str,
           CASE kind WHEN 'nav' THEN 'USD' WHEN 'yield' THEN 'bps' ELSE NULL END AS unit,
           CASE WHEN kind = 'class' THEN 'SOURCED'
                WHEN kind = 'yield' AND l_linenumber = 7 AND l_returnflag = 'R' THEN 'STALE'
                WHEN kind = 'yield' AND l_partkey % 17 = 2 THEN 'UNKNOWN' WHEN kind = 'yield' THEN 'SOURCED'
                WHEN (l_partkey + l_suppkey) % 61 = 0 THEN 'REVOKED'
                WHEN (l_partkey + l_suppkey) % 67 = 1 THEN 'CONFLICTING'
                WHEN l_partkey % 13 = 4 THEN 'INFERRED'
                WHEN l_linestatus = 'F' AND l_linenumber > 4 THEN 'VERIFIED' ELSE 'SOURCED' END AS state,
           CASE WHEN l_partkey % 47 = 0 THEN {d.empty()}
                WHEN l_partkey % 43 = 0 THEN {d.arr("'snap:other'")}
                WHEN l_suppkey % 17 = 3 THEN {d.arr("'snap:gone:' || CAST(l_suppkey AS STRING)")}
                ELSE {d.arr("'snap:' || CAST(l_suppkey AS STRING)", "'manual'")} END AS source_refs,
           CASE WHEN kind <> 'nav' THEN {d.arr(own)}
                WHEN (l_partkey + l_linenumber) % 89 = 0 THEN {d.empty()}
                WHEN (l_partkey * 7 + l_suppkey) % 59 = 0 THEN {d.arr("'evidence:missing:' || k")}
                WHEN l_linenumber % 2 = 0
                THEN {d.arr(own, "'evidence:order:' || CAST(l_orderkey AS STRING)")}
                ELSE {d.arr(own)} END AS evidence_refs,
           CASE WHEN kind <> 'nav' OR l_linenumber <> 3 THEN {d.empty()}
                WHEN l_partkey % 37 = 0 THEN {d.arr("'att:gone:' || CAST(l_orderkey AS STRING)")}
                ELSE {d.arr("'att:' || CAST(l_orderkey AS STRING)")} END AS attestation_refs,
           CASE WHEN l_discount > 0.095 THEN NULL ELSE 1 - l_discount * 5 END AS confidence,
           {d.ms('l_shipdate')} AS observed_at,
           CASE WHEN l_linenumber = 6 THEN {d.ms('l_shipdate')} + CAST(365 AS BIGINT) * 86400000 ELSE NULL END AS expires_at,
           {d.ms('l_shipdate')} + 60000 AS created_at
    FROM {_keyed_lines(d, "'nav'", "'yield'", "'class'")}"""


def edges(d) -> str:
    return f"""
    SELECT 'edge:' || k || ':' || kind AS edge_id, 'object:' || CAST(l_orderkey AS STRING) AS object_id,
           CASE kind WHEN 'source' THEN 'evidence:' || k ELSE 'claim:' || k || ':' || kind END AS from_ref,
           CASE WHEN kind = 'source' THEN 'snap:' || CAST(l_suppkey AS STRING)
                WHEN l_partkey % 53 = 0 THEN 'evidence:elsewhere:' || k ELSE 'evidence:' || k END AS to_ref,
           CASE kind WHEN 'source' THEN 'OBSERVED_FROM' ELSE 'SUPPORTED_BY' END AS relation
    FROM {_keyed_lines(d, "'nav'", "'yield'", "'class'", "'source'")}"""


def attestations(d) -> str:
    signature = f"'0x' || {d.sha('CAST(o_orderkey AS STRING)')} || {d.sha('CAST(o_custkey AS STRING)')}"
    return f"""
    SELECT 'att:' || CAST(o_orderkey AS STRING) AS attestation_id,
           'object:' || CAST(o_orderkey AS STRING) AS object_id,
           'object:' || CAST(o_orderkey AS STRING) AS subject,
           'claim:attested:' || CAST(o_orderkey AS STRING) AS claim_ref,
           CASE WHEN o_orderkey % 71 = 0 THEN '' ELSE 'nav-attestation' END AS schema_name,
           CASE WHEN o_custkey % 2 = 0 THEN '0xABC' ELSE '0xabc' END || CAST(o_custkey AS STRING) AS attestor,
           CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '0x' || {d.sha('o_orderpriority')} END AS evidence_root,
           CASE WHEN o_orderkey % 17 = 0 THEN '0x' WHEN o_orderkey % 19 = 0 THEN 'unsigned'
                ELSE {signature} || 'ff' END AS signature,
           {d.ms('o_orderdate')} AS issued_at,
           CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 5 = 1 THEN NULL
                ELSE {d.ms('o_orderdate')} + CAST(1825 AS BIGINT) * 86400000 END AS expires_at,
           CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN {d.ms('o_orderdate')} + 1000 ELSE NULL END AS revoked_at,
           CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'REVOKED'
                WHEN o_orderstatus = 'F' THEN 'EXPIRED' ELSE 'ACTIVE' END AS state
    FROM {d.raw('orders')}"""


def attestors(d) -> str:
    return f"""
    SELECT '0xabc' || CAST(c_custkey AS STRING) AS attestor FROM {d.raw('customer')}
    WHERE c_acctbal >= 500"""


def signatures(d) -> str:
    """Signatures whose recovery was done elsewhere: verified and refused ones."""
    signature = f"'0x' || {d.sha('CAST(o_orderkey AS STRING)')} || {d.sha('CAST(o_custkey AS STRING)')}"
    return f"""
    SELECT {signature} || 'ff' AS signature, o_totalprice < 450000 AS valid
    FROM {d.raw('orders')} WHERE o_totalprice < 200000 OR o_totalprice > 450000"""


def contents(d) -> str:
    """Stored bodies of order evidence; some differ from what was hashed, some are lost."""
    return f"""
    SELECT 'evidence:order:' || CAST(o_orderkey AS STRING) AS evidence_id,
           'object:' || CAST(o_orderkey AS STRING) AS object_id,
           CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderkey % 101 = 0 THEN 'changed ' || CAST(o_orderkey AS STRING)
                ELSE 'order ' || CAST(o_orderkey AS STRING) END AS content
    FROM {d.raw('orders')}"""


def exceptions(d) -> str:
    """One exception per line; most are superseded and of kinds that say nothing about the object."""
    key = _line_key()
    live = "l_tax > 0.075 AND l_discount > 0.085"
    return f"""
    SELECT 'exception:' || {key} AS exception_id, 'object:' || CAST(l_orderkey AS STRING) AS object_id,
           CASE CASE WHEN {live} THEN l_partkey % 10 ELSE 6 + l_partkey % 3 END
                WHEN 0 THEN 'EVIDENCE_STALE' WHEN 1 THEN 'EVIDENCE_CONFLICT'
                WHEN 2 THEN 'EVIDENCE_MISSING' WHEN 3 THEN 'IDENTITY_AMBIGUOUS'
                WHEN 4 THEN 'RELATIONSHIP_AMBIGUOUS' WHEN 5 THEN 'ATTESTATION_REVOKED'
                WHEN 6 THEN 'SOURCE_FAILURE' WHEN 7 THEN 'VERIFICATION_FAILED'
                WHEN 8 THEN 'POLICY_AMBIGUOUS' ELSE 'UNSUPPORTED_REPRESENTATION' END AS type,
           CASE l_linenumber % 3 WHEN 0 THEN 'INFO' WHEN 1 THEN 'WARNING' ELSE 'BLOCKING' END AS severity,
           {d.arr(f"'claim:' || {key} || ':nav'")} AS affected_claims,
           {d.arr(f"'evidence:' || {key}")} AS evidence_refs,
           {d.ms('l_shipdate')} AS detected_at,
           CASE WHEN NOT ({live}) THEN 'SUPERSEDED' WHEN l_linestatus = 'F' THEN 'WAIVED' ELSE 'OPEN' END AS status
    FROM {d.raw('lineitem')}"""


def _mandate_versions(d) -> str:
    """Customers once per version of their mandate: every fourth has two, and every eleventh none."""
    held = f"FROM {d.raw('customer')} WHERE c_custkey % 11 <> 3"
    return f"(SELECT *, 1 AS version {held} UNION ALL SELECT *, 2 AS version {held} AND c_custkey % 4 = 0) m"


def mandates(d) -> str:
    """The second version of a mandate lasts longer and forbids another class than the first."""
    return f"""
    SELECT 'mandate:' || CAST(c_custkey AS STRING) AS mandate_id, version,
           c_name AS principal, 'hold ' || c_mktsegment AS objective,
           CASE c_mktsegment WHEN 'BUILDING' THEN {d.arr("'1-URGENT'", "'2-HIGH'", "'F'")}
                WHEN 'MACHINERY' THEN {d.arr("'3-MEDIUM'", "'O'", "'P'")} ELSE {d.empty()} END AS allowed,
           CASE WHEN version = 2 THEN {d.arr("'2-HIGH'")} WHEN c_nationkey % 5 = 0 THEN {d.arr("'5-LOW'")}
                WHEN c_nationkey % 5 = 1 THEN {d.arr("'4-NOT SPECIFIED'", "'5-LOW'")}
                ELSE {d.empty()} END AS prohibited,
           {d.arr("'N' || CAST(c_nationkey AS STRING)")} AS jurisdictions,
           CASE WHEN version = 2 THEN NULL WHEN c_nationkey % 9 = 0 THEN {NOW_MS} - 1 WHEN c_nationkey % 9 = 1 THEN {NOW_MS}
                ELSE NULL END AS expires_at,
           CAST(c_nationkey * 10 AS DOUBLE) AS min_yield_bps,
           CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE CAST(2000 AS BIGINT) * 86400000 END AS max_evidence_age_ms,
           CASE WHEN c_nationkey % 6 < 4 THEN NULL ELSE c_nationkey END AS max_redemption_days
    FROM {_mandate_versions(d)}"""


def required_claims(d) -> str:
    return f"""
    SELECT 'mandate:' || CAST(c_custkey AS STRING) AS mandate_id, version, 1 AS ord,
           'nav' AS property, CASE WHEN c_nationkey % 2 = 0 THEN 'SOURCED' ELSE 'VERIFIED' END AS required_state
    FROM {_mandate_versions(d)} WHERE c_mktsegment <> 'HOUSEHOLD'
    UNION ALL
    SELECT 'mandate:' || CAST(c_custkey AS STRING), version, 2, 'yieldBps', 'SOURCED'
    FROM {_mandate_versions(d)} WHERE version = 1 AND c_mktsegment IN ('BUILDING', 'AUTOMOBILE')
    UNION ALL
    SELECT 'mandate:' || CAST(c_custkey AS STRING), version, 3, 'issuer', 'ATTESTED'
    FROM {_mandate_versions(d)} WHERE c_mktsegment = 'FURNITURE' AND c_acctbal > 8000"""


def required_evidence(d) -> str:
    return f"""
    SELECT 'mandate:' || CAST(c_custkey AS STRING) AS mandate_id, version, 1 AS ord,
           'OTHER' AS type, CASE WHEN c_nationkey % 3 = 0 THEN NULL
                                 ELSE CAST(1500 AS BIGINT) * 86400000 END AS max_age_ms
    FROM {_mandate_versions(d)}
    UNION ALL
    SELECT 'mandate:' || CAST(c_custkey AS STRING), version, 2, 'DOCUMENT', CAST(2000 AS BIGINT) * 86400000
    FROM {_mandate_versions(d)} WHERE c_acctbal > 5000"""


def assignments(d) -> str:
    """Which object version is judged under which mandate version: the order's customer.

    Some name a version of the object that does not exist, some a mandate that does not.
    """
    return f"""
    SELECT 'object:' || CAST(o_orderkey AS STRING) AS object_id, CASE WHEN o_orderkey % 37 = 5 THEN 2 ELSE 1 END AS version,
           'mandate:' || CAST(o_custkey AS STRING) AS mandate_id,
           CASE WHEN o_custkey % 4 = 0 AND o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS mandate_version
    FROM {d.raw('orders')}"""


def profiles(d) -> str:
    return f"""
    SELECT 'rep:' || CAST(p_partkey AS STRING) AS id, p_type AS asset_class,
           CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS issuer,
           CASE p_size % 4 WHEN 0 THEN 'institutional' WHEN 1 THEN 'Retail' WHEN 2 THEN 'retail' ELSE NULL END AS share_class,
           CASE WHEN p_partkey % 4 = 0 THEN 'CUSIP' || CAST(p_partkey % 50 AS STRING) ELSE NULL END AS cusip,
           CASE WHEN p_partkey % 22 = 0 THEN 'ISIN' || CAST(p_partkey AS STRING) ELSE NULL END AS isin,
           CASE WHEN p_partkey % 2 = 0 THEN upper(split_part(p_name, ' ', 1)) ELSE split_part(p_name, ' ', 1) END AS ticker,
           CASE WHEN p_partkey % 13 = 0 THEN 'lockbox' ELSE NULL END AS bridge_mechanism,
           p_partkey % 17 = 0 AS is_wrapped,
           CASE WHEN p_partkey % 9 = 1 THEN {d.empty()}
                ELSE {d.arr("'evidence:type:' || p_type", "'evidence:part:' || CAST(p_partkey AS STRING)")} END AS evidence_refs,
           CASE WHEN p_partkey % 3 = 1 THEN 'rep:' || CAST(p_partkey - 1 AS STRING) ELSE NULL END AS parent,
           CASE WHEN p_partkey % 6 = 1 THEN 'BRIDGED_REPRESENTATION_OF' ELSE 'REPRESENTS' END AS relationship,
           CASE p_size % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'monthly' ELSE NULL END AS redemption_terms,
           CASE p_partkey % 7 WHEN 0 THEN 'EVM' WHEN 1 THEN 'SOLANA' WHEN 2 THEN 'CANTON' WHEN 3 THEN 'MOON' ELSE 'OFFCHAIN' END AS environment,
           CASE p_partkey % 5 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'PAUSED' ELSE 'UNKNOWN' END AS status,
           CASE WHEN p_size % 10 = 0 THEN 'TICKER' ELSE 'CUSIP' END AS scheme,
           CASE p_partkey % 8 WHEN 0 THEN 1952 WHEN 1 THEN 196 WHEN 2 THEN 195 ELSE CAST(p_size AS INT) END AS chain_id
    FROM {d.raw('part')}"""


def pairs(d) -> str:
    """Representations bought together with the first one of an order, once per pair."""
    return f"""
    SELECT DISTINCT 'rep:' || CAST(a.anchor AS STRING) AS a_id, 'rep:' || CAST(l.l_partkey AS STRING) AS b_id
    FROM {d.raw('lineitem')} l
    JOIN (SELECT l_orderkey AS okey, min(l_partkey) AS anchor FROM {d.raw('lineitem')} GROUP BY l_orderkey) a
      ON l.l_orderkey = a.okey
    WHERE l.l_partkey <> a.anchor
    UNION
    SELECT 'rep:' || CAST(p_partkey - 1 AS STRING), 'rep:' || CAST(p_partkey AS STRING)
    FROM {d.raw('part')} WHERE p_partkey > 0"""


def relationships(d) -> str:
    return f"""
    SELECT 'rel:' || {_line_key()} AS relationship_id,
           'proposal:' || CAST(l_orderkey AS STRING) AS proposal_id,
           'rep:' || CAST(l_partkey AS STRING) AS subject,
           CASE l_linenumber WHEN 1 THEN 'REPRESENTS' WHEN 2 THEN 'ISSUED_BY' WHEN 3 THEN 'SIMILAR_TO'
                WHEN 4 THEN 'ECONOMICALLY_EQUIVALENT_TO' WHEN 5 THEN 'BACKED_BY' ELSE 'SUPERSEDES' END AS predicate,
           CASE WHEN l_partkey % 97 = 0 THEN '' ELSE 'rep:' || CAST(l_suppkey AS STRING) END AS object,
           CASE WHEN l_partkey % 83 = 0 THEN 'GUESSED' ELSE 'SOURCED' END AS state,
           CASE WHEN l_discount > 0.095 THEN 1.2 ELSE 1 - l_discount END AS confidence,
           {d.ms('l_shipdate')} AS observed_at,
           CASE WHEN l_linenumber = 5 THEN CAST(-1 AS BIGINT) ELSE {d.ms('l_shipdate')} END AS valid_from,
           CAST(NULL AS BIGINT) AS valid_until,
           l_linenumber <> 6 AS is_equivalent,
           CASE WHEN l_partkey % 29 = 0 THEN {d.empty()}
                WHEN l_partkey % 41 = 0 THEN {d.arr(f"'evidence:missing:' || {_line_key()}", f"'evidence:' || {_line_key()}")}
                ELSE {d.arr(f"'evidence:' || {_line_key()}")} END AS evidence_refs
    FROM {d.raw('lineitem')}"""


def group_claims(d) -> str:
    """Claims on a (part, supplier) subject; several sources quote the same property."""
    return f"""
    SELECT 'claim:' || k || ':' || kind AS claim_id,
           'offer:' || CAST(l_partkey AS STRING) || ':' || CAST(l_suppkey AS STRING) AS subject,
           CASE kind WHEN 'class' THEN 'shareClass' WHEN 'tax' THEN 'taxRate' ELSE 'issuer' END AS property,
           CASE WHEN kind <> 'tax' OR l_linenumber = 7 THEN 'string' WHEN l_linenumber = 6 THEN 'boolean' ELSE 'number' END AS value_kind,
           CASE WHEN kind = 'tax' AND l_linenumber < 6 THEN l_tax ELSE NULL END AS value_num,
           CASE WHEN kind = 'class' AND l_linenumber % 2 = 0 THEN ' ' || l_returnflag WHEN kind = 'class' THEN lower(l_returnflag)
                WHEN kind = 'tax' AND l_linenumber = 7 THEN 'none' WHEN kind = 'tax' THEN NULL
                WHEN l_linestatus = 'F' THEN 'Issuer' || CAST(l_quantity > 25 AS STRING)
                ELSE 'issuer ' || CAST(l_quantity > 25 AS STRING) END AS value_str,
           CASE WHEN kind = 'class' THEN '"' || l_returnflag || '"' WHEN kind = 'issuer' THEN '"issuer"'
                WHEN l_linenumber = 7 THEN '"none"' WHEN l_linenumber = 6 THEN 'true'
                ELSE CAST(CAST(round(l_tax * 100) AS BIGINT) AS STRING) END AS value_json,
           CASE kind WHEN 'issuer' THEN {d.empty()} ELSE {d.arr("'evidence:' || k")} END AS evidence_refs
    FROM {_keyed_lines(d, "'class'", "'tax'", "'issuer'")}"""


def proposed_claims(d) -> str:
    key = _line_key()
    return f"""
    SELECT 'proposal:' || CAST(l_orderkey AS STRING) AS proposal_id, 'prop:' || {key} AS id,
           'object:' || CAST(l_orderkey AS STRING) AS subject,
           'nav' AS property, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS value_json,
           'USD' AS unit,
           CASE WHEN l_partkey % 91 = 0 THEN 1.5 ELSE 1 - l_discount END AS confidence, l_returnflag = 'N' AS is_direct,
           CASE WHEN l_partkey % 47 = 0 THEN {d.empty()}
                WHEN l_suppkey % 17 = 3 THEN {d.arr("'snap:' || CAST(l_suppkey AS STRING)", "'snap:gone'")}
                ELSE {d.arr("'snap:' || CAST(l_suppkey AS STRING)")} END AS source_refs,
           CASE WHEN l_partkey % 43 = 0 THEN {d.empty()}
                WHEN l_partkey % 37 = 0 THEN {d.arr(f"'evidence:missing:' || {key}")}
                ELSE {d.arr(f"'evidence:' || {key}", "'evidence:order:' || CAST(l_orderkey AS STRING)")} END AS evidence_refs
    FROM {d.raw('lineitem')}"""


def documents(d) -> str:
    """Document bodies with a clause in filing language; every third one is JSON."""
    did = "CAST(doc_id AS STRING)"
    code = "substr('00000000' || CAST(doc_id % 100000 AS STRING), length(CAST(doc_id % 100000 AS STRING)))"
    price = "CAST(100 + doc_id % 9 AS STRING) || '.' || CAST(10 + doc_id % 80 AS STRING)"
    structured = f"""
        '{{' || CASE doc_id % 4 WHEN 0 THEN '"fundName":"Fund {{0}}",' WHEN 1 THEN '"assetName":"  ","name":"Asset","product":7,'
                WHEN 2 THEN '"fund":"F","cusip":"C1234567","symbol":"SYM",' ELSE '"isin":"US0000000001","ticker":"TCK","symbol":"S2",' END
        || CASE doc_id % 5 WHEN 0 THEN '"nav":' || {price} || ',' WHEN 1 THEN '"nav":"n/a","sharePrice":"' || {price} || '","currency":"EUR",'
                WHEN 2 THEN '"netAssetValue":null,"price":12,' WHEN 3 THEN '"nav":"",' ELSE '' END
        || CASE doc_id % 7 WHEN 0 THEN '"yieldBps":512,' WHEN 1 THEN '"yieldBps":"x","yield":5.125,' WHEN 2 THEN '"apy":-0.5,'
                WHEN 3 THEN '"couponBps":"75","apy":1,' WHEN 4 THEN '"yield":null,' WHEN 5 THEN '"apyBps":true,' ELSE '' END
        || CASE doc_id % 3 WHEN 0 THEN '"shareClass":"Institutional","issuer":"I' || CAST(doc_id % 6 AS STRING) || '",'
                ELSE '' END
        || CASE doc_id % 11 WHEN 0 THEN '"reservesAdequacy":"FULL",' WHEN 1 THEN '"collateralRatio":1.5,"sponsor":"S",' ELSE '' END
        || CASE doc_id % 8 WHEN 0 THEN '"redemption":{{"window":"weekly","terms":"T+2 notice"}},'
                WHEN 1 THEN '"liquidity":{{"frequency":"monthly","noticePeriod":"5d"}},"transferable":false,'
                WHEN 2 THEN '"redemptionWindow":"quarterly","beneficialOwnership":true,' WHEN 3 THEN '"redemption":"",'
                WHEN 4 THEN '"redemption":true,' WHEN 5 THEN '"redemption":{{"transferable":false}},' ELSE '' END
        || CASE doc_id % 10 WHEN 0 THEN '"distribution":{{"terms":"paid monthly"}},' WHEN 1 THEN '"coupon":0,' WHEN 2 THEN '"coupon":"0",' ELSE '' END
        || CASE doc_id % 13 WHEN 0 THEN '"eligibility":{{"criteria":"QIB only"}},' WHEN 1 THEN '"investorType":"professional",'
                WHEN 2 THEN '"kycRequired":true,' WHEN 3 THEN '"eligibility":[1],' WHEN 4 THEN '"kycRequired":false,' ELSE '' END
        || CASE doc_id % 9 WHEN 0 THEN '"jurisdiction":"CH",' WHEN 3 THEN '"excludedJurisdictions":["US","KP"],'
                WHEN 6 THEN '"jurisdictionRestrictions":true,' ELSE '' END
        || '"id":' || {did} || ',"notes":"' || {d.clean('text')} || '"}}'"""
    prose = f"""
        text || CASE doc_id % 4 WHEN 0 THEN ' CUSIP: ' || {code} || '. ' WHEN 1 THEN ' ISIN No. US' || substr({code} || '00000', 1, 10) || ', '
                 ELSE ' ' END
        || CASE doc_id % 5 WHEN 0 THEN 'Net Asset Value is $' || {price} || ' USD. ' WHEN 1 THEN 'NAV of ' || {price} || ' EUR; '
                WHEN 2 THEN 'NAV: ' || {price} || ' per unit. ' ELSE '' END
        || CASE doc_id % 6 WHEN 1 THEN 'Share Class: Institutional. ' WHEN 2 THEN 'Series Retail only. ' WHEN 4 THEN 'class is Class B. ' ELSE '' END
        || CASE doc_id % 7 WHEN 0 THEN 'Redemption window: daily T+1. ' WHEN 1 THEN 'The redemption period is 30 days; non-transferable. '
                WHEN 2 THEN 'Held without redemption: never. ' WHEN 3 THEN 'Redemption: terms' WHEN 4 THEN 'redemption is at NAV by the beneficial owner' ELSE '' END
        || CASE doc_id % 8 WHEN 1 THEN ' For Qualified Purchaser investors.' WHEN 2 THEN ' Accredited Investor status needed.'
                WHEN 5 THEN ' Offered under Regulation S.' WHEN 7 THEN ' Non-US persons only.' ELSE '' END"""
    return f"""
    SELECT doc_id, 'snap:doc:' || {did} AS snapshot_id, 'evidence:doc:' || {did} AS evidence_id,
           'fund:' || source || ':' || CAST(doc_id % 13 AS STRING) AS subject,
           CASE WHEN doc_id % 3 = 0 THEN {structured} ELSE {prose} END AS body,
           CASE doc_id % 9 WHEN 0 THEN 'PRIMARY_SOURCE' WHEN 1 THEN 'REFERENCE_DATA' WHEN 2 THEN 'MARKET_DATA'
                WHEN 3 THEN 'ONCHAIN_STATE' WHEN 4 THEN 'AUTHORIZED_ATTESTOR' WHEN 5 THEN 'DERIVED'
                ELSE 'PRIMARY_SOURCE' END AS authority,
           CASE WHEN doc_id % 12 = 5 THEN 'STALE' WHEN doc_id % 12 = 7 THEN NULL ELSE 'FRESH' END AS freshness,
           lang, source
    FROM {d.raw('documents')}"""


def feed(d) -> str:
    return f"""
    SELECT url AS source_ref, page_id,
           CASE page_id % 7 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'AUTH_FAILED' WHEN 2 THEN 'UPSTREAM_ERROR' ELSE 'OK' END AS status,
           CASE WHEN page_id % 7 = 3 THEN NULL ELSE html END AS data,
           {NOW_MS} - page_id * 1000 AS observed_at
    FROM {d.raw('pages')}"""


def cases(d) -> str:
    """Labelled cases: a rule's answer beside what the labels say."""
    return f"""
    SELECT 'case:' || CAST(t.doc_id AS STRING) AS case_id,
           CASE t.doc_id % 4 WHEN 0 THEN 'claim' WHEN 1 THEN 'rights' WHEN 2 THEN 'relationship' ELSE 'conflict' END AS category,
           l.quality = 1 AS expected,
           t.n_chars > 200 AS predicted,
           l.toxic = 1 AS must_block
    FROM {d.raw('documents')} t JOIN {d.raw('labels')} l ON t.doc_id = l.doc_id"""


def runs(d) -> str:
    return f"""
    SELECT 'run:' || CAST(conv_id AS STRING) AS run_id,
           'model:' || CAST(conv_id % 3 AS STRING) AS model_id,
           {NOW_MS} + conv_id * 1000 AS started_at,
           {NOW_MS} + conv_id * 1000 + count(*) * 250 - CASE WHEN conv_id % 9 = 0 THEN 2000 ELSE 0 END AS completed_at,
           CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE {d.words('text')} END) AS BIGINT) AS input_tokens,
           CAST(sum(CASE WHEN role = 'assistant' THEN {d.words('text')} ELSE 0 END) AS BIGINT) AS output_tokens,
           CASE conv_id % 5 WHEN 0 THEN 'REJECTED_TIMEOUT' WHEN 1 THEN 'CRASHED' ELSE 'SUCCESS' END AS status
    FROM {d.raw('conversations')} GROUP BY conv_id"""


def changes(d) -> str:
    return f"""
    SELECT 'change:' || CAST(event_id AS STRING) AS event_id, 'object:user:' || CAST(user_id AS STRING) AS object_id,
           CASE event_type WHEN 'error' THEN 'EVIDENCE_REVOKED' WHEN 'click' THEN 'EVIDENCE_STALE'
                WHEN 'signup' THEN 'SOURCE_UPDATED' WHEN 'purchase' THEN 'ATTESTATION_REVOKED'
                ELSE 'MANUAL_REFRESH' END AS change_type,
           CASE WHEN value < 8 THEN 'INFERRED' ELSE 'SOURCED' END AS update_state,
           {d.ms('ts')} AS ts_ms, ts, CAST(round(value * 100) AS BIGINT) AS value_cents, event_id AS seq,
           'corr:' || CAST(event_id AS STRING) AS correlation_id
    FROM {d.raw('events')}"""


def commit_calls(d) -> str:
    """Calls against the commitment log, in `seq` order per object."""
    return f"""
    SELECT event_id AS seq, 'object:user:' || CAST(user_id AS STRING) AS object_id,
           CASE event_type WHEN 'signup' THEN 'register' WHEN 'purchase' THEN 'update' WHEN 'click' THEN 'update'
                WHEN 'view' THEN 'attest' ELSE 'revoke' END AS call,
           CASE WHEN event_type IN ('purchase', 'click') THEN CAST(1 + floor(value) % 4 AS BIGINT) ELSE NULL END AS expected_version,
           CASE WHEN event_id % 37 = 0 THEN '0x' || repeat('0', 64) ELSE '0x' || {d.sha("'root ' || CAST(event_id AS STRING)")} END AS object_root,
           CASE WHEN event_id % 41 = 0 THEN '0x' || repeat('0', 64) ELSE '0x' || {d.sha("'proof ' || CAST(event_id AS STRING)")} END AS evidence_root,
           'claim:' || CAST(event_id % 3 AS STRING) AS claim_id,
           '0x' || {d.sha("'hash ' || CAST(CAST(floor(value) % 2 AS BIGINT) AS STRING)")} AS attestation_hash,
           'rep:' || CAST(event_id % 5 AS STRING) AS representation_id,
           'sender:' || CAST(event_id % 7 AS STRING) AS sender
    FROM {d.raw('events')}"""


def roles(d) -> str:
    """Role intervals on the log order: half-open [role_from, role_to)."""
    return f"""
    SELECT 'sender:' || CAST(u % 7 AS STRING) AS sender, CASE WHEN u % 2 = 0 THEN 'publisher' ELSE 'attestor' END AS role,
           u * 50 AS role_from, u * 50 + 400 AS role_to
    FROM (SELECT DISTINCT user_id AS u FROM {d.raw('events')}) k"""


def pauses(d) -> str:
    return f"""
    SELECT u * 70 AS pause_from, u * 70 + 10 AS pause_to
    FROM (SELECT DISTINCT user_id AS u FROM {d.raw('events')}) k"""


def stored_versions(d) -> str:
    return f"""
    SELECT 'object:' || CAST(o_orderkey AS STRING) AS object_id, 1 AS version,
           '0x' || {d.sha("'v1 ' || o_orderstatus")} AS root
    FROM {d.raw('orders')}"""


def version_batch(d) -> str:
    return f"""
    SELECT 'object:' || CAST(l_orderkey AS STRING) AS object_id, 1 + l_linenumber % 4 AS version,
           {_line_key()} AS seq,
           '0x' || {d.sha("'v' || CAST(1 + l_linenumber % 4 AS STRING) || ' ' || CASE WHEN l_linestatus = 'F' THEN 'P' ELSE l_returnflag END")} AS root
    FROM {d.raw('lineitem')}"""


def parties(d) -> str:
    return f"""
    SELECT 'party:' || CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey % 31 = 0 THEN '' ELSE 'HOLDER' END AS role,
           CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE c_name END AS name,
           {d.arr("'claim:party:' || CAST(c_custkey AS STRING)", "CASE WHEN c_custkey % 41 = 0 THEN '' ELSE 'claim:role' END")} AS claim_refs
    FROM {d.raw('customer')}"""


def terms(d) -> str:
    """Rights and obligations; `holder` is the holder or the obligor."""
    return f"""
    SELECT CASE WHEN p_partkey % 3 = 0 THEN 'obligation' ELSE 'right' END AS kind,
           'term:' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_size = 7 THEN '' ELSE p_type END AS type,
           CASE WHEN p_size = 9 THEN '' WHEN p_size = 10 THEN NULL ELSE p_brand END AS holder,
           CASE WHEN p_size = 11 THEN NULL ELSE '{{}}' END AS terms,
           {d.arr("'claim:term'", "p_name")} AS claim_refs
    FROM {d.raw('part')}"""


def scopes(d) -> str:
    return f"""
    SELECT 'restriction:' || CAST(n_nationkey AS STRING) AS id, 'JURISDICTION' AS type,
           CASE WHEN n_regionkey = 2 THEN '' ELSE n_name END AS scope,
           {d.arr("'claim:scope'")} AS claim_refs,
           CASE WHEN n_regionkey = 3 THEN {d.arr("''")} ELSE {d.arr("'evidence:scope'")} END AS evidence_refs
    FROM {d.raw('nation')}"""


def economics(d) -> str:
    return f"""
    SELECT 'object:' || CAST(o_orderkey AS STRING) AS object_id,
           CASE WHEN o_totalprice < 5000 THEN CAST(-1 AS BIGINT) ELSE {d.ms('o_orderdate')} END AS as_of,
           CASE WHEN o_totalprice > 490000 THEN NULL
                ELSE '{{"total":' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING) || '}}' END AS state_values,
           {d.arr("'claim:total'")} AS claim_refs
    FROM {d.raw('orders')}"""


def reported_checks(d) -> str:
    key = _line_key()
    return f"""
    SELECT 'check:' || {key} AS check_id, CASE WHEN l_discount > 0.095 THEN '' ELSE 'FRESHNESS' END AS check_type,
           'claim:' || {key} AS subject,
           CASE l_returnflag WHEN 'A' THEN 'PASS' WHEN 'N' THEN 'FAIL' ELSE CASE WHEN l_tax > 0.075 THEN 'MAYBE' ELSE 'UNRESOLVED' END END AS result,
           {d.arr(f"'evidence:' || {key}")} AS evidence_refs,
           CASE WHEN l_quantity = 1 THEN '' ELSE 'v1' END AS rule_version,
           CASE WHEN l_quantity = 2 THEN CAST(-5 AS BIGINT) ELSE {d.ms('l_shipdate')} END AS timestamp
    FROM {d.raw('lineitem')}"""


def drafts(d) -> str:
    """Proposed rights, restrictions, conflicts and issues with their proposal header."""
    return f"""
    SELECT 'draft:' || CAST(p_partkey AS STRING) AS id, 'rep:' || CAST(p_partkey AS STRING) AS subject,
           CASE p_size % 5 WHEN 0 THEN 'LEGAL_OWNER' WHEN 1 THEN 'TOKEN_HOLDER' WHEN 2 THEN 'OWNER' ELSE 'RECORD_HOLDER' END AS holder_type,
           CASE p_size % 7 WHEN 0 THEN 'INCOME' WHEN 1 THEN 'DIVIDEND' ELSE 'REDEMPTION' END AS right_type,
           CASE WHEN p_size = 3 THEN '' ELSE p_name END AS terms,
           CASE p_size % 4 WHEN 0 THEN 'TRANSFERABLE' WHEN 1 THEN 'LOCKED' ELSE 'RESTRICTED' END AS transferability,
           p_retailprice / 1500 AS confidence,
           CASE p_size % 6 WHEN 0 THEN 'ELIGIBILITY' WHEN 1 THEN 'LOCKUP' WHEN 2 THEN 'SANCTION' ELSE 'OTHER' END AS restriction_type,
           'conflict:' || CAST(p_partkey AS STRING) AS conflict_id, CASE WHEN p_size = 4 THEN '' ELSE 'nav' END AS property,
           CASE p_size % 3 WHEN 0 THEN 'STALE_SOURCE' WHEN 1 THEN 'NOISE' ELSE 'OTHER' END AS likely_cause,
           CASE p_size % 8 WHEN 0 THEN 'FATAL' ELSE 'BLOCKING' END AS severity,
           'issue:' || CAST(p_partkey AS STRING) AS issue_id,
           CASE p_size % 9 WHEN 0 THEN 'LOST' ELSE 'EVIDENCE_MISSING' END AS issue_type,
           'proposal:' || p_brand AS proposal_id, CASE WHEN p_size = 5 THEN '' ELSE 'run:1' END AS run_id,
           'prompt-v1' AS prompt_version, 'schema-v1' AS schema_version,
           CASE WHEN p_size % 10 = 1 THEN '0x12' ELSE '0x' || {d.sha('p_name')} END AS proposal_hash,
           CAST(p_size - 2 AS BIGINT) AS created_at
    FROM {d.raw('part')}"""


def object_documents(d) -> str:
    """Object documents as JSON text, with unknown keys and bad nested values in places."""
    okey = "CAST(o_orderkey AS STRING)"
    return f"""
    SELECT 'object:' || {okey} AS object_id,
           '{{"id":"' || CASE WHEN o_orderkey % 61 = 0 THEN '' ELSE 'object:' || {okey} END
           || '","version":' || CAST(o_orderkey % 40 AS STRING)
           || ',"status":"' || CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' WHEN 'O' THEN 'STALE'
                                    ELSE CASE WHEN o_totalprice > 400000 THEN 'OPEN' ELSE 'REVOKED' END END
           || '","claims":[{{"id":"c1","state":"SOURCED"}},{{"id":"c2","state":"'
           || CASE o_orderpriority WHEN '5-LOW' THEN 'GUESSED' ELSE 'VERIFIED' END || '"}}]'
           || CASE WHEN o_totalprice < 20000 THEN '' ELSE ',"evidence":[{{"id":"e1","type":"' ||
                   CASE WHEN o_totalprice < 40000 THEN 'RUMOUR' ELSE 'FILING' END || '"}}]' END
           || CASE WHEN o_custkey % 19 = 0 THEN ',"comment":"x","tags":[]' ELSE '' END || '}}' AS json
    FROM {d.raw('orders')}"""


def _quoted(value: str) -> str:
    return f"'\"' || {value} || '\"'"


def _json(parts: dict[str, str], more: str = "''") -> str:
    """SQL text of a JSON object: keys, and SQL that gives the JSON of their values; `more` adds raw members."""
    members = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in parts.items())
    return f"'{{' || {members} || {more} || '}}'"


def whole_documents(d) -> str:
    """Whole object documents with all their nested parts, each part broken in some of them."""
    okey = "CAST(o_orderkey AS STRING)"
    fixed = lambda text: "'" + text + "'"
    if_ = lambda test, bad, good: f"CASE WHEN {test} THEN {bad} ELSE {good} END"
    one_of = lambda test, bad, good: if_(test, fixed(bad), fixed(good))
    text = lambda value: fixed(f'"{value}"')
    ref, refs, day = _quoted(f"'r:' || {okey}"), fixed('["a","b"]'), d.ms("o_orderdate")
    bad_refs = one_of("o_custkey % 7 = 0", '["a","",3]', "[]")
    millis = f"CAST({day} AS STRING)"
    identifier = _json(
        {"scheme": one_of("o_custkey % 5 = 0", '"TICKER"', '"ISIN"'), "value": one_of("o_custkey % 9 = 0", '""', '"US0001"'), "source": ref, "status": text("SOURCED")},
        one_of("o_custkey % 13 = 0", ',"namespace":null', ""),
    )
    claim = _json(
        {"id": ref, "subject": ref, "property": text("nav"), "value": one_of("o_custkey % 6 = 0", '{"deep":[{"odd":""}]}', "null"),
         "state": one_of("o_orderpriority = '5-LOW'", '"GUESSED"', '"SOURCED"'), "sourceRefs": refs, "evidenceRefs": bad_refs,
         "attestationRefs": "'[]'", "createdAt": if_("o_custkey % 8 = 0", "'-5'", millis)},
        one_of("o_custkey % 10 = 0", ',"confidence":1.5,"weight":1', ',"confidence":0.5'),
    )
    parts = {
        "id": if_("o_orderkey % 61 = 0", "'\"\"'", _quoted(f"'object:' || {okey}")),
        "version": if_("o_custkey % 12 = 0", "'1.5'", "CAST(o_orderkey % 40 AS STRING)"),
        "classification": _json({"primary": text("FUND"), "secondary": one_of("o_custkey % 11 = 0", '"x"', '["y",""]'), "confidence": one_of("o_custkey % 14 = 0", '"high"', "0.75"), "claimRef": ref}),
        "identifiers": f"'[' || {identifier} || ']'",
        "representations": "'[' || " + _json({"id": ref, "environment": one_of("o_custkey % 15 = 0", '"MAINFRAME"', '"EVM"'), "identifiers": f"'[' || {identifier} || ',' || {identifier} || ']'",
                                              "relationshipToObject": ref, "status": text("ACTIVE"), "evidence": bad_refs}, one_of("o_custkey % 16 = 0", ',"contract":7', "")) + " || ']'",
        "relationships": "'[' || " + _json({"id": ref, "subject": ref, "predicate": one_of("o_custkey % 17 = 0", '"RESEMBLES"', '"CLAIM_ON"'), "object": ref, "state": text("SOURCED"),
                                            "evidence": refs, "attestations": refs}, one_of("o_custkey % 18 = 0", ',"validFrom":2.5,"validUntil":-1', "")) + " || ']'",
        "parties": "'[' || " + _json({"id": ref, "role": one_of("o_custkey % 20 = 0", "null", '"ISSUER"'), "name": text("A"), "identifiers": f"'[' || {identifier} || ']'", "claimRefs": refs}) + " || ']'",
        "rights": "'[' || " + _json({"id": ref, "type": text("VOTING"), "terms": one_of("o_custkey % 21 = 0", '["free"]', '{"free":1}'), "claimRefs": refs}) + " || ',3]'",
        "obligations": "'[' || " + _json({"id": ref, "type": text("FEE"), "terms": "'{}'"}, one_of("o_custkey % 22 = 0", "", ',"claimRefs":[],"obligor":"o"')) + " || ']'",
        "restrictions": "'[' || " + _json({"id": ref, "type": text("LOCKUP"), "scope": one_of("o_custkey % 23 = 0", '""', '"US"'), "claimRefs": refs, "evidenceRefs": refs}) + " || ']'",
        "economics": if_("o_custkey % 24 = 0", "'[]'", _json({"asOf": millis, "values": one_of("o_custkey % 25 = 0", "1", '{"nav":1}'), "claimRefs": bad_refs})),
        "claims": f"'[' || {claim} || {if_('o_totalprice > 100000', chr(39) + ',' + chr(39) + ' || ' + claim, chr(39) * 2)} || ']'",
        "evidence": "'[' || " + _json({"id": ref, "type": one_of("o_totalprice < 40000", '"RUMOUR"', '"FILING"'), "source": ref, "contentHash": one_of("o_custkey % 26 = 0", '"0xZZ"', '"0xab"'), "observedAt": millis,
                                       "fetchedAt": millis, "authority": text("PRIMARY_SOURCE"), "metadata": "'{}'"}, one_of("o_custkey % 27 = 0", ',"freshness":"OLD"', "")) + " || ']'",
        "attestations": "'[' || " + _json({"id": ref, "subject": ref, "claimRef": ref, "schema": text("s"), "attestor": ref, "signature": one_of("o_custkey % 28 = 0", '"ab"', '"0xab"'), "issuedAt": millis, "state": text("ACTIVE")}) + " || ']'",
        "exceptions": "'[' || " + _json({"id": ref, "objectId": ref, "type": text("EVIDENCE_STALE"), "severity": one_of("o_custkey % 29 = 0", '"LOUD"', '"INFO"'), "affectedClaims": refs, "evidence": refs, "detectedAt": millis,
                                         "status": text("OPEN")}, one_of("o_custkey % 30 = 0", ',"resolutionOptions":[1]', ',"resolutionOptions":[""]')) + " || ']'",
        "provenance": "'{\"edges\":[' || " + _json({"id": ref, "from": ref, "to": ref, "relation": one_of("o_custkey % 31 = 0", '""', '"CITES"')}, one_of("o_custkey % 32 = 0", ',"weight":1', "")) + " || ']}'",
        "status": one_of("o_orderstatus = 'F'", '"OPEN"', '"RESOLVED"'),
    }
    check = _json({"id": ref, "type": text("FRESH"), "subject": ref, "result": one_of("o_custkey % 33 = 0", '"MAYBE"', '"PASS"'), "evidence": bad_refs, "ruleVersion": text("1"), "timestamp": millis})
    last = _json({"status": text("PASS"), "verifierVersion": text("v"), "checks": f"'[' || {check} || ']'"}, one_of("o_custkey % 34 = 0", ',"objectRoot":"none"', ""))
    tail = if_("o_custkey % 19 = 0", "',\"comment\":\"x\",\"tags\":[]'", f"',\"verification\":' || {last}")
    return f"""SELECT 'object:' || {okey} AS object_id, {_json(parts, tail)} AS json FROM {d.raw('orders')}"""


def _change_lines(d) -> str:
    """Every line of an order as a change of the order's object; `seq` orders them."""
    return f"""(SELECT *, 'object:' || CAST(l_orderkey AS STRING) AS object_id, CAST(l_linenumber AS STRING) || ':' || {_line_key()} AS seq,
                    l_linenumber = 1 OR l_partkey % 3 > 0 AS sets_claims, l_linenumber = 1 OR l_suppkey % 2 = 0 AS sets_evidence,
                    l_linenumber < 3 OR l_partkey % 5 = 0 AS sets_attestations, l_tax > 0.06 AS sets_exceptions
             FROM {d.raw('lineitem')}) lines"""


def object_changes(d) -> str:
    """Changes of objects and the collections that each replaces; some replace none."""
    return f"""
    SELECT object_id, seq, {d.ms('l_shipdate')} AS ts_ms,
           CASE l_linenumber % 4 WHEN 0 THEN 'EVIDENCE_STALE' WHEN 1 THEN 'SOURCE_UPDATED' WHEN 2 THEN 'ATTESTATION_REVOKED' ELSE 'MANUAL_REFRESH' END AS change_type,
           sets_claims, sets_evidence, sets_attestations, sets_exceptions
    FROM {_change_lines(d)}"""


def change_claims(d) -> str:
    """Claims that a change brings; one that brings none clears them."""
    okey = "CAST(l_orderkey AS STRING)"
    return f"""
    SELECT object_id, seq, 'claim:' || {okey} || ':' || kind AS claim_id, CASE kind WHEN 'nav' THEN 'nav' ELSE 'yieldBps' END AS property,
           CASE WHEN kind = 'yield' AND l_partkey % 17 = 2 THEN 'UNKNOWN' WHEN kind = 'yield' THEN 'SOURCED' WHEN l_partkey % 11 = 3 THEN 'REVOKED'
                WHEN l_partkey % 13 = 4 THEN 'CONFLICTING' WHEN l_suppkey % 7 = 5 THEN 'INFERRED' WHEN l_partkey % 8 = 1 THEN 'STALE'
                WHEN l_suppkey % 3 = 0 THEN 'VERIFIED' ELSE 'SOURCED' END AS state,
           CASE WHEN kind = 'yield' THEN {d.arr("'evidence:' || CAST(l_orderkey AS STRING) || ':b'")} WHEN l_partkey % 23 = 0 THEN {d.empty()}
                WHEN l_partkey % 19 = 0 THEN {d.arr("'evidence:gone:' || CAST(l_orderkey AS STRING)")}
                ELSE {d.arr("'evidence:' || CAST(l_orderkey AS STRING) || ':a'", "'evidence:' || CAST(l_orderkey AS STRING) || ':b'")} END AS evidence_refs,
           CASE WHEN kind = 'nav' AND l_suppkey % 4 = 0 THEN {d.arr("'att:' || CAST(l_orderkey AS STRING)")} ELSE {d.empty()} END AS attestation_refs
    FROM (SELECT *, {d.each("'nav'", "'yield'")} AS kind FROM {_change_lines(d)}) k
    WHERE sets_claims AND l_partkey % 29 > 0"""


def change_evidence(d) -> str:
    return f"""
    SELECT object_id, seq, 'evidence:' || CAST(l_orderkey AS STRING) || ':' || kind AS evidence_id,
           CASE kind WHEN 'a' THEN 'OTHER' ELSE 'DOCUMENT' END AS type, 'snap:' || CAST(l_suppkey AS STRING) AS source,
           '0x' || {d.sha("'body ' || CAST(l_partkey AS STRING)")} AS content_hash, CASE kind WHEN 'a' THEN 'line:1' ELSE NULL END AS locator,
           {d.ms('l_shipdate')} AS observed_at, {d.ms('l_shipdate')} + 3600000 AS fetched_at,
           CASE WHEN l_suppkey % 9 = 7 THEN 'AI_INFERENCE' ELSE 'PRIMARY_SOURCE' END AS authority,
           CASE WHEN kind = 'b' AND l_partkey % 7 = 0 THEN 'STALE' WHEN kind = 'a' THEN 'FRESH' ELSE NULL END AS freshness,
           '{{"part":' || CAST(l_partkey AS STRING) || '}}' AS metadata_json
    FROM (SELECT *, {d.each("'a'", "'b'")} AS kind FROM {_change_lines(d)}) k
    WHERE sets_evidence AND l_suppkey % 31 > 0"""


def change_attestations(d) -> str:
    return f"""
    SELECT object_id, seq, 'att:' || CAST(l_orderkey AS STRING) AS attestation_id,
           CASE WHEN l_partkey % 4 = 3 THEN 'REVOKED' ELSE 'ACTIVE' END AS state,
           CASE WHEN l_partkey % 6 = 5 THEN {NOW_MS} - 1 WHEN l_partkey % 6 = 4 THEN 0 ELSE NULL END AS expires_at,
           '0xABC' || CAST(l_suppkey AS STRING) AS attestor,
           CASE WHEN l_partkey % 9 = 1 THEN 'unsigned'
                ELSE '0x' || {d.sha("CAST(l_orderkey AS STRING)")} || {d.sha("CAST(l_partkey AS STRING)")} || 'ff' END AS signature
    FROM {_change_lines(d)} WHERE sets_attestations"""


def change_exceptions(d) -> str:
    return f"""
    SELECT object_id, seq, 'exception:' || seq AS exception_id,
           CASE l_partkey % 6 WHEN 0 THEN 'EVIDENCE_STALE' WHEN 1 THEN 'EVIDENCE_CONFLICT' WHEN 2 THEN 'IDENTITY_AMBIGUOUS'
                WHEN 3 THEN 'ATTESTATION_REVOKED' ELSE 'SOURCE_FAILURE' END AS type
    FROM {_change_lines(d)} WHERE sets_exceptions AND l_partkey % 5 > 1"""


def object_identifiers(d) -> str:
    return f"""
    SELECT 'object:' || CAST(l_orderkey AS STRING) AS object_id, 'identifier:' || {_line_key()} AS id,
           CASE l_linenumber % 4 WHEN 0 THEN 'ISIN' WHEN 1 THEN 'CUSIP' WHEN 2 THEN 'CONTRACT' ELSE 'CUSTOM' END AS scheme,
           'value:' || CAST(l_partkey AS STRING) AS value, CASE WHEN l_linenumber % 4 = 3 THEN 'ns' ELSE NULL END AS namespace,
           'snap:' || CAST(l_suppkey AS STRING) AS source, CASE WHEN l_returnflag = 'A' THEN 'VERIFIED' ELSE 'SOURCED' END AS status
    FROM {d.raw('lineitem')}"""


def object_representations(d) -> str:
    return f"""
    SELECT 'object:' || CAST(l_orderkey AS STRING) AS object_id, 'representation:' || {_line_key()} AS id,
           CASE l_partkey % 4 WHEN 0 THEN 'EVM' WHEN 1 THEN 'SOLANA' WHEN 2 THEN 'CANTON' ELSE 'OFFCHAIN' END AS environment,
           CASE WHEN l_partkey % 4 < 2 THEN 'net:' || CAST(l_suppkey % 5 AS STRING) ELSE NULL END AS network,
           CASE WHEN l_partkey % 4 = 0 THEN 'contract:' || CAST(l_partkey AS STRING) ELSE NULL END AS contract,
           CASE WHEN l_partkey % 4 = 0 THEN 'token' ELSE NULL END AS token_standard, 'REPRESENTS' AS relationship,
           CASE WHEN l_linestatus = 'F' THEN 'ACTIVE' ELSE 'UNKNOWN' END AS status, {d.arr(f"'evidence:' || {_line_key()}")} AS evidence_refs
    FROM {d.raw('lineitem')} WHERE l_linenumber < 4"""


def object_relationships(d) -> str:
    return f"""
    SELECT 'object:' || CAST(l_orderkey AS STRING) AS object_id, 'relationship:' || {_line_key()} AS id,
           'object:' || CAST(l_orderkey AS STRING) AS subject, CASE WHEN l_linenumber % 2 = 0 THEN 'SIMILAR_TO' ELSE 'BACKED_BY' END AS predicate,
           'object:part:' || CAST(l_partkey AS STRING) AS object, CASE WHEN l_returnflag = 'N' THEN 'INFERRED' ELSE 'SOURCED' END AS state,
           {d.arr(f"'evidence:' || {_line_key()}")} AS evidence_refs, {d.empty()} AS attestation_refs,
           CASE WHEN l_returnflag = 'N' THEN 'model:1' ELSE NULL END AS inferred_by, CAST(round((1 - l_discount) * 1000000) AS BIGINT) AS confidence,
           {d.ms('l_shipdate')} AS observed_at, {d.ms('l_shipdate')} AS valid_from, CAST(NULL AS BIGINT) AS valid_until
    FROM {d.raw('lineitem')} WHERE l_linenumber > 4"""


def object_parties(d) -> str:
    return f"""
    SELECT 'object:' || CAST(o_orderkey AS STRING) AS object_id, 'party:' || CAST(o_custkey AS STRING) AS id,
           'HOLDER' AS role, 'customer ' || CAST(o_custkey AS STRING) AS name, {d.arr("'claim:party:' || CAST(o_custkey AS STRING)")} AS claim_refs
    FROM {d.raw('orders')}"""


def object_terms(d) -> str:
    """Rights and obligations of objects; `holder` is the holder or the obligor."""
    return f"""
    SELECT 'object:' || CAST(l_orderkey AS STRING) AS object_id, CASE WHEN l_linenumber % 2 = 0 THEN 'rights' ELSE 'obligations' END AS kind,
           'term:' || {_line_key()} AS id, CASE WHEN l_suppkey % 2 = 0 THEN 'REDEMPTION' ELSE 'INCOME' END AS type,
           CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'party:' || CAST(l_suppkey AS STRING) END AS holder,
           '{{"days":' || CAST(l_suppkey % 90 AS STRING) || '}}' AS terms, {d.arr("'claim:term'")} AS claim_refs
    FROM {d.raw('lineitem')} WHERE l_linenumber < 5"""


def object_restrictions(d) -> str:
    return f"""
    SELECT 'object:' || CAST(l_orderkey AS STRING) AS object_id, 'restriction:' || {_line_key()} AS id, 'JURISDICTION' AS type,
           'nation:' || CAST(l_suppkey % 25 AS STRING) AS scope, {d.arr("'claim:scope'")} AS claim_refs, {d.arr(f"'evidence:' || {_line_key()}")} AS evidence_refs
    FROM {d.raw('lineitem')} WHERE l_suppkey % 4 = 1"""


def object_checks(d) -> str:
    return f"""
    SELECT 'object:' || CAST(l_orderkey AS STRING) AS object_id, 'check:' || {_line_key()} AS id, 'FRESHNESS' AS type,
           'claim:' || {_line_key()} || ':nav' AS subject, CASE l_returnflag WHEN 'A' THEN 'PASS' WHEN 'N' THEN 'FAIL' ELSE 'UNRESOLVED' END AS result,
           {d.arr(f"'evidence:' || {_line_key()}")} AS evidence_refs, 'v1' AS rule_version, {d.ms('l_shipdate')} AS timestamp
    FROM {d.raw('lineitem')} WHERE l_linenumber % 3 = 1"""


def log_rows(d) -> str:
    """Deliveries of chain log rows; the same row may come again, or be taken back."""
    return f"""
    SELECT 1952 AS chain_id, 'tx:' || CAST(user_id AS STRING) AS tx_hash, CAST(floor(value) AS BIGINT) % 8 AS log_index,
           event_id AS delivery, event_type = 'error' AS removed, 'data:' || event_type AS payload
    FROM {d.raw('events')}"""


def readings(d) -> str:
    """Timed readings of sources, with stale and failed ones."""
    return f"""
    SELECT ts AS event_time, 'source:' || event_type AS source, value < 10 AS stale, value >= 60 AS failed
    FROM {d.raw('events')}"""


DEFINITIONS = {
    f.__name__: f
    for f in (
        objects, snapshots, evidence, claims, edges, attestations, attestors, signatures, contents,
        exceptions, mandates, required_claims, required_evidence, assignments, profiles, pairs,
        relationships, group_claims, proposed_claims, documents, feed, cases, runs, changes,
        commit_calls, roles, pauses, stored_versions, version_batch, parties, terms, scopes, economics,
        reported_checks, drafts, object_documents, whole_documents, object_changes, change_claims, change_evidence,
        change_attestations, change_exceptions, object_identifiers, object_representations, object_relationships,
        object_parties, object_terms, object_restrictions, object_checks, log_rows, readings,
    )
}


def cte_prefix(names: list[str]) -> str:
    """DuckDB definitions of the named domain tables."""
    return ", ".join(f"b_{n} AS ({DEFINITIONS[n](DuckDialect)})" for n in names)


class Tables:
    """Serves raw and domain tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        """A raw table. A large one that comes in fewer pieces than there are cores is spread out.

        A single row group is read by a single task whatever its size; tables of many row
        groups have enough pieces and are left as they are.
        """
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        if name in SPREAD and df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DEFINITIONS:
            raise AttributeError(name)
        sql = DEFINITIONS[name](SparkDialect)
        used = {n: self.raw(n) for n in RAW if "{" + n + "}" in sql}
        return self.spark.sql(_escape(sql, used), **used)


def _escape(sql: str, names) -> str:
    """Double every brace that is not a table placeholder."""
    marked = re.sub(r"\{(%s)\}" % "|".join(names), "\x01\\1\x02", sql)
    return marked.replace("{", "{{").replace("}", "}}").replace("\x01", "{").replace("\x02", "}")


class StreamTables(Tables):
    """The same tables as unbounded file streams."""

    def raw(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}*.parquet")
