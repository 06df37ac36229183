"""Candidate claims, rights and restrictions from document bodies.

Input is `bodies(subject, snapshot_id, evidence_id, body)`. A body that is a JSON object is
read by keys, any other text by patterns over the whole text. Bodies are scanned once: each
extractor gives a struct or null, and the non-null ones are exploded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions.dynamic import Node, either, parsed, with_keys
from ..functions.expr import fan_out, ident, numeric, trimmed

IDENTITY_KEYS = ["fundName", "assetName", "name", "fund", "product"]
NAV_KEYS = ["nav", "sharePrice", "netAssetValue", "price"]
YIELD_KEYS = ["yieldBps", "apyBps", "couponBps", "yield", "apy"]
ISSUER_KEYS = ["issuer", "fundManager", "sponsor", "entity"]


KEYS = sorted({
    *IDENTITY_KEYS, *NAV_KEYS, *YIELD_KEYS, *ISSUER_KEYS, "cusip", "isin", "ticker", "symbol", "currency",
    "shareClass", "reservesAdequacy", "collateralRatio", "redemption", "liquidity", "redemptionWindow",
    "transferable", "beneficialOwnership", "distribution", "coupon", "eligibility", "investorType",
    "kycRequired", "jurisdiction", "jurisdictionRestrictions", "excludedJurisdictions",
})
# Matches over prose: (pattern, group, words of which one must occur for the pattern to match).
MATCHES = {
    "m_cusip": (X.CUSIP_TEXT, 1, ["cusip"]),
    "m_isin": (X.ISIN_TEXT, 1, ["isin"]),
    "m_nav": (X.NAV_TEXT, 1, ["nav", "net asset value"]),
    "m_nav_unit": (X.NAV_TEXT, 2, ["nav", "net asset value"]),
    "m_class": (X.SHARE_CLASS_TEXT, 1, ["class", "series"]),
    "m_redemption": (X.REDEMPTION_TEXT, 1, ["redemption"]),
}


def _claim(prop: str, confidence: float, locator: Column | str, *, text: Column | None = None,
           number: Column | None = None, unit: Column | str | None = None, direct: bool = True) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(prop).alias("property"),
        (none.cast("string") if text is None else text).alias("value_str"),
        (none.cast("double") if number is None else number).alias("value_num"),
        (F.lit(unit) if unit is None or isinstance(unit, str) else unit).cast("string").alias("unit"),
        F.lit(confidence).alias("confidence"), F.lit(direct).alias("is_direct"),
        (F.lit(locator) if isinstance(locator, str) else locator).alias("locator"),
    )


def _first(candidates: list[tuple[Column, Column]]) -> Column:
    """Value of the first condition that holds, else null."""
    chain = F.when(*candidates[0])
    for condition, value in candidates[1:]:
        chain = chain.when(condition, value)
    return chain


def identity_json() -> Column:
    nodes = [(key, Node(key)) for key in IDENTITY_KEYS]
    return _first([
        (n.is_text() & (F.length(trimmed(n.as_text())) > 0),
         _claim("economicIdentity", 1.0, f"json:$.{key}", text=n.as_text()))
        for key, n in nodes
    ])


def cusip_json() -> Column:
    n = Node("cusip")
    return F.when(n.is_text(), _claim("cusip", 1.0, "json:$.cusip", text=n.as_text()))


def isin_json() -> Column:
    n = Node("isin")
    return F.when(n.is_text(), _claim("isin", 1.0, "json:$.isin", text=n.as_text()))


def ticker_json() -> Column:
    ticker, symbol = Node("ticker"), Node("symbol")
    named = either(ticker, symbol).as_text()
    return F.when(ticker.is_text() | symbol.is_text(), _claim("ticker", 1.0, "json:$.ticker", text=named))


def nav_json() -> Column:
    currency = Node("currency")
    unit = F.coalesce(F.when(currency.given(), currency.as_text()), F.lit("USD"))
    found = [(key, Node(key).number_or_text()) for key in NAV_KEYS]
    return _first([
        (value.isNotNull(), _claim("nav", 0.98, f"json:$.{key}", number=value, unit=unit)) for key, value in found
    ])


def yield_json() -> Column:
    candidates = []
    for key in YIELD_KEYS:
        direct = key.endswith("Bps")
        value = Node(key).coerced()
        points = value if direct else F.floor(value * 100 + 0.5).cast("double")
        candidates.append((
            value.isNotNull(), _claim("yieldBps", 0.95, f"json:$.{key}", number=points, unit="bps", direct=direct)
        ))
    return _first(candidates)


def share_class_json() -> Column:
    n = Node("shareClass")
    return F.when(n.is_text(), _claim("shareClass", 0.95, "json:$.shareClass", text=n.as_text()))


def issuer_json() -> Column:
    nodes = [(key, Node(key)) for key in ISSUER_KEYS]
    return _first([(n.is_text(), _claim("issuer", 0.95, f"json:$.{key}", text=n.as_text())) for key, n in nodes])


def reserves_json() -> Column:
    declared, ratio = Node("reservesAdequacy"), Node("collateralRatio")
    value = either(declared, ratio)
    where = F.when(declared.defined(), "json:$.reservesAdequacy").otherwise("json:$.collateralRatio")
    return F.when(
        declared.is_text() | ratio.is_number(),
        _claim("reservesAdequacy", 0.95, where, text=value.text(), number=value.number()),
    )


def _prose(match: str, claim: Column) -> Column:
    return F.when(F.col(match).isNotNull(), claim)


def cusip_text() -> Column:
    return _prose("m_cusip", _claim("cusip", 0.95, "text:regex:CUSIP", text=F.col("m_cusip")))


def isin_text() -> Column:
    return _prose("m_isin", _claim("isin", 0.95, "text:regex:ISIN", text=F.col("m_isin")))


def nav_text() -> Column:
    unit = F.coalesce("m_nav_unit", F.lit("USD"))
    return _prose("m_nav", _claim("nav", 0.90, "text:regex:NAV", number=numeric(F.col("m_nav")), unit=unit))


def share_class_text() -> Column:
    return _prose("m_class", _claim("shareClass", 0.88, "text:regex:ShareClass", text=F.lower("m_class")))


JSON_EXTRACTORS = [
    identity_json, cusip_json, isin_json, ticker_json, nav_json, yield_json, share_class_json, issuer_json, reserves_json,
]
TEXT_EXTRACTORS = [cusip_text, isin_text, nav_text, share_class_text]


def read_bodies(bodies: DataFrame) -> DataFrame:
    """Bodies with what the extractors read; unused columns are pruned again.

    `doc` is the parsed object and null for prose; `low` is lower-cased prose and null for
    objects. A pattern only runs over a text that holds one of its words. Empty bodies go.
    """
    kept = bodies.filter(F.length("body") > 0).withColumn("doc", parsed(F.col("body")))
    told = with_keys(kept, "doc", KEYS).withColumn("low", F.when(F.col("doc").isNull(), F.lower("body")))
    found = {}
    for name, (pattern, group, words) in MATCHES.items():
        held = F.contains(F.col("low"), F.lit(words[0]))
        for word in words[1:]:
            held = held | F.contains(F.col("low"), F.lit(word))
        found[name] = F.when(held, F.nullif(F.regexp_extract("body", pattern, group), F.lit("")))
    return told.withColumns(found)


def extract_claims(
    bodies: DataFrame,
    extractors: list[Callable[[], Column]] | None = None,
    min_confidence: float = 0.5,
    properties: list[str] | None = None,
) -> DataFrame:
    """Proposed claims of all bodies, one row each."""
    chosen = extractors or JSON_EXTRACTORS + TEXT_EXTRACTORS
    rows = read_bodies(bodies).select(
        "subject", "snapshot_id", "evidence_id", fan_out(*[make() for make in chosen]).alias("c")
    ).select("subject", "snapshot_id", "evidence_id", "c.*")
    kept = rows.filter(F.col("confidence") >= min_confidence)
    if properties:
        kept = kept.filter(F.col("property").isin(properties))
    return kept.withColumn(
        "id", ident("claim", "prop", F.col("subject"), F.col("property"), F.col("snapshot_id"))
    )


# --- rights and restrictions ------------------------------------------------------------


def _term(kind: str, type_: str, terms: Column | str, confidence: float, *, holder: Column | str | None = None,
          transfer: Column | str | None = None, window: Column | None = None) -> Column:
    def lit(x):
        return (F.lit(x) if x is None or isinstance(x, str) else x).cast("string")

    return F.struct(
        F.lit(kind).alias("kind"), F.lit(type_).alias("type"), lit(holder).alias("holder_type"), lit(terms).alias("terms"),
        lit(transfer).alias("transferability"), lit(window).alias("redemption_window"), F.lit(confidence).alias("confidence"),
    )


def redemption_json() -> Column:
    redemption, liquidity, window = (Node(k) for k in ("redemption", "liquidity", "redemptionWindow"))
    inner = either(redemption, liquidity)
    open_ = F.coalesce(window.text(), inner.child("window").text(), inner.child("frequency").text(), F.lit("daily"))
    terms = F.coalesce(
        inner.child("terms").text(),
        F.concat(F.lit("Notice period: "), inner.child("noticePeriod").text()),
        F.concat(F.lit("Redemption window: "), open_),
    )
    locked = Node("transferable").is_false() | inner.child("transferable").is_false()
    holder = F.when(Node("beneficialOwnership").is_true(), "BENEFICIAL_OWNER").otherwise("TOKEN_HOLDER")
    return F.when(
        redemption.truthy() | liquidity.truthy() | window.truthy(),
        _term("RIGHT", "REDEMPTION", terms, 0.95, holder=holder,
              transfer=F.when(locked, "RESTRICTED").otherwise("TRANSFERABLE"), window=open_),
    )


def income_json() -> Column:
    distribution, *others = (Node(k) for k in ("distribution", "yield", "coupon", "yieldBps"))
    due = distribution.truthy()
    for node in others:
        due = due | node.truthy()
    terms = F.coalesce(distribution.child("terms").text(), F.lit(X.INCOME_TERMS))
    transfer = F.when(Node("transferable").is_false(), "RESTRICTED").otherwise("TRANSFERABLE")
    return F.when(due, _term("RIGHT", "INCOME", terms, 0.92, holder="TOKEN_HOLDER", transfer=transfer))


def eligibility_json() -> Column:
    eligibility, investor, kyc = (Node(k) for k in ("eligibility", "investorType", "kycRequired"))
    criteria = F.coalesce(
        eligibility.child("criteria").text(), investor.text(),
        F.when(kyc.is_true(), X.KYC_CRITERIA).otherwise(X.OTHER_CRITERIA),
    )
    return F.when(
        eligibility.truthy() | investor.truthy() | kyc.truthy(), _term("RESTRICTION", "ELIGIBILITY", criteria, 0.95)
    )


def jurisdiction_json() -> Column:
    named, scope, excluded = (
        Node(k) for k in ("jurisdiction", "jurisdictionRestrictions", "excludedJurisdictions")
    )
    listed = F.try_variant_get(excluded.value, "$", "array<string>")
    where = F.coalesce(
        named.text(), F.concat(F.lit("Excluded: "), F.array_join(listed, ", ")), F.lit(X.JURISDICTION_DEFAULT)
    )
    return F.when(
        named.truthy() | scope.truthy() | excluded.truthy(), _term("RESTRICTION", "JURISDICTION", where, 0.95)
    )


def _says(phrase: str) -> Column:
    """Prose holding a phrase in any case; null for objects."""
    return F.contains(F.col("low"), F.lit(phrase))


def redemption_text() -> Column:
    clause = trimmed(F.col("m_redemption"))
    told = clause.isNotNull() & (F.lower(clause) != "terms") & ~_says("without redemption") & ~_says("no redemption")
    return F.when(
        told,
        _term("RIGHT", "REDEMPTION", clause, 0.88,
              holder=F.when(_says("beneficial owner"), "BENEFICIAL_OWNER").otherwise("TOKEN_HOLDER"),
              transfer=F.when(_says("non-transferable"), "NON_TRANSFERABLE").otherwise("RESTRICTED"), window=clause),
    )


def eligibility_text() -> Column:
    purchaser = _says("qualified purchaser")
    criteria = F.when(purchaser, X.QUALIFIED_PURCHASER).otherwise(X.ACCREDITED_INVESTOR)
    return F.when(
        purchaser | _says("accredited investor"),
        _term("RESTRICTION", "ELIGIBILITY", criteria, 0.95),
    )


def jurisdiction_text() -> Column:
    return F.when(
        _says("regulation s") | _says("non-us persons only"),
        _term("RESTRICTION", "JURISDICTION", X.REGULATION_S, 0.95),
    )


TERM_EXTRACTORS = [
    redemption_json, income_json, eligibility_json, jurisdiction_json, redemption_text, eligibility_text, jurisdiction_text,
]


def extract_terms(bodies: DataFrame, extractors: list[Callable[[], Column]] | None = None) -> DataFrame:
    """Proposed rights and restrictions of all bodies, one row each."""
    rows = read_bodies(bodies).select(
        "subject", "snapshot_id", "evidence_id", fan_out(*[make() for make in extractors or TERM_EXTRACTORS]).alias("t")
    ).select("subject", "snapshot_id", "evidence_id", "t.*")
    prefix = F.when(F.col("kind") == "RIGHT", "right").otherwise("rest")
    return rows.withColumn("id", ident(prefix, "prop", F.col("subject"), F.lower("type"), F.col("snapshot_id")))


def missing_redemption(subjects: DataFrame, terms: DataFrame) -> DataFrame:
    """Subjects with evidence but no redemption right anywhere."""
    having = terms.filter((F.col("kind") == "RIGHT") & (F.col("type") == "REDEMPTION")).select("subject")
    return subjects.select("subject").distinct().join(having, "subject", "left_anti").select(
        ident("issue", "unresolved", F.col("subject"), "redemption").alias("id"), "subject",
        F.lit("EVIDENCE_MISSING").alias("issue_type"), F.lit("redemptionTerms").alias("dimension"),
    )


def interpret_rights(bodies: DataFrame) -> DataFrame:
    """Rights, restrictions and open issues in one stream, told apart by `kind`."""
    terms = extract_terms(bodies)
    issues = missing_redemption(bodies, terms).select(
        "id", "subject", F.lit("ISSUE").alias("kind"), F.col("issue_type").alias("type")
    )
    return terms.unionByName(issues, allowMissingColumns=True)
