"""Extraction over whole document bodies."""

from .. import fixed as X
from ..operators import extract as e
from ..operators import lookups
from .registry import query

SPLIT = """docs AS MATERIALIZED (
  SELECT subject, snapshot_id, evidence_id, body, CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' ELSE false END AS structured
  FROM b_documents),
j AS MATERIALIZED (SELECT subject, snapshot_id, evidence_id, body FROM docs WHERE structured),
p AS MATERIALIZED (SELECT subject, snapshot_id, evidence_id, body, lower(body) AS low FROM docs WHERE NOT structured)"""
NUM = "'^\\s*[+-]?(Infinity|([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)\\s*$'"


def kind(key: str) -> str:
    return f"json_type(body, '$.{key}')"


def text(key: str) -> str:
    return f"CASE WHEN {kind(key)} = 'VARCHAR' THEN json_extract_string(body, '$.{key}') END"


def number(key: str) -> str:
    s = f"json_extract_string(body, '$.{key}')"
    return (
        f"CASE WHEN {kind(key)} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST({s} AS DOUBLE) "
        f"WHEN {kind(key)} = 'VARCHAR' AND regexp_matches({s}, {NUM}) THEN CAST({s} AS DOUBLE) END"
    )


def coerced(key: str) -> str:
    s = f"json_extract_string(body, '$.{key}')"
    return f"CASE {kind(key)} WHEN 'NULL' THEN 0.0 WHEN 'BOOLEAN' THEN CASE {s} WHEN 'true' THEN 1.0 ELSE 0.0 END ELSE {number(key)} END"


def truthy(key: str) -> str:
    s = f"json_extract_string(body, '$.{key}')"
    return (
        f"coalesce(CASE {kind(key)} WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN {s} = 'true' WHEN 'VARCHAR' THEN {s} <> '' "
        f"WHEN 'OBJECT' THEN true WHEN 'ARRAY' THEN true ELSE CAST({s} AS DOUBLE) <> 0 END, false)"
    )


def claim(prop, confidence, locator, value_str="NULL", value_num="NULL", unit="NULL", direct="true", source="j", where="true"):
    return f"""SELECT subject, snapshot_id, evidence_id, '{prop}' AS property, CAST({value_str} AS VARCHAR) AS value_str,
      CAST({value_num} AS DOUBLE) AS value_num, CAST({unit} AS VARCHAR) AS unit, CAST({confidence} AS DOUBLE) AS confidence,
      {direct} AS is_direct, {locator} AS locator, 'claim:prop:' || subject || ':{prop}:' || snapshot_id AS id
      FROM {source} WHERE {where}"""


def first_key(keys, test):
    """CASE giving the first key whose test holds."""
    return "CASE " + " ".join(f"WHEN {test(k)} THEN '{k}'" for k in keys) + " END"


def keyed(keys, test, value):
    """Rows of j with the chosen key and its value."""
    chosen = "CASE " + " ".join(f"WHEN {test(k)} THEN {value(k)}" for k in keys) + " END"
    return f"(SELECT *, {first_key(keys, test)} AS k, {chosen} AS v FROM j) x"


IDENTITY = claim("economicIdentity", "1.0", "'json:$.' || k", "v", source=keyed(
    e.IDENTITY_KEYS, lambda k: f"trim(coalesce({text(k)}, '')) <> ''", text), where="k IS NOT NULL")
IDENTIFIERS = " UNION ALL ".join([
    claim("cusip", "1.0", "'json:$.cusip'", text("cusip"), where=f"{kind('cusip')} = 'VARCHAR'"),
    claim("isin", "1.0", "'json:$.isin'", text("isin"), where=f"{kind('isin')} = 'VARCHAR'"),
    claim("ticker", "1.0", "'json:$.ticker'", f"coalesce({text('ticker')}, {text('symbol')})",
          where=f"coalesce({kind('ticker')} = 'VARCHAR', false) OR coalesce({kind('symbol')} = 'VARCHAR', false)"),
])
NAV = claim("nav", "0.98", "'json:$.' || k", value_num="v", unit=f"coalesce({text('currency')}, 'USD')",
            source=keyed(e.NAV_KEYS, lambda k: f"({number(k)}) IS NOT NULL", number), where="k IS NOT NULL")
YIELD = claim("yieldBps", "0.95", "'json:$.' || k", value_num="CASE WHEN k LIKE '%Bps' THEN v ELSE floor(v * 100 + 0.5) END",
              unit="'bps'", direct="k LIKE '%Bps'",
              source=keyed(e.YIELD_KEYS, lambda k: f"({coerced(k)}) IS NOT NULL", coerced), where="k IS NOT NULL")
SHARE_CLASS = claim("shareClass", "0.95", "'json:$.shareClass'", text("shareClass"), where=f"{kind('shareClass')} = 'VARCHAR'")
ISSUER = claim("issuer", "0.95", "'json:$.' || k", "v",
               source=keyed(e.ISSUER_KEYS, lambda k: f"coalesce({kind(k)} = 'VARCHAR', false)", text), where="k IS NOT NULL")
RESERVES = claim("reservesAdequacy", "0.95", f"CASE WHEN {kind('reservesAdequacy')} IS NOT NULL THEN 'json:$.reservesAdequacy' ELSE 'json:$.collateralRatio' END",
                 text("reservesAdequacy"), f"CASE WHEN {kind('reservesAdequacy')} IS NULL THEN {number('collateralRatio')} END",
                 where=f"coalesce({kind('reservesAdequacy')} = 'VARCHAR', false) OR coalesce({kind('collateralRatio')} IN ('BIGINT', 'UBIGINT', 'DOUBLE'), false)")


def prose(prop, confidence, name, pattern, value_str="NULL", value_num="NULL", unit="NULL"):
    return claim(prop, confidence, f"'text:regex:{name}'", value_str, value_num, unit,
                 source=f"(SELECT *, regexp_extract(body, '{pattern}', 1) AS m FROM p) x", where="m <> ''")


IDS_TEXT = prose("cusip", "0.95", "CUSIP", X.CUSIP_TEXT, "m") + " UNION ALL " + prose("isin", "0.95", "ISIN", X.ISIN_TEXT, "m")
NAV_PROSE = prose("nav", "0.90", "NAV", X.NAV_TEXT, value_num="m",
                  unit=f"CASE regexp_extract(body, '{X.NAV_TEXT}', 2) WHEN '' THEN 'USD' ELSE regexp_extract(body, '{X.NAV_TEXT}', 2) END")
CLASS_PROSE = prose("shareClass", "0.88", "ShareClass", X.SHARE_CLASS_TEXT, "lower(m)")
ALL_CLAIMS = " UNION ALL ".join(
    [IDENTITY, IDENTIFIERS, NAV, YIELD, SHARE_CLASS, ISSUER, RESERVES, IDS_TEXT, NAV_PROSE, CLASS_PROSE]
)


def extraction(name: str, oracle: str, *extractors):
    @query(name, f"WITH {SPLIT} {oracle}")
    def run(t):
        return e.extract_claims(t.documents, list(extractors))

    return run


extraction("e1_extract_identity", IDENTITY, e.identity_json)
extraction("e2_extract_identifiers_json", IDENTIFIERS, e.cusip_json, e.isin_json, e.ticker_json)
extraction("e3_extract_nav_json", NAV, e.nav_json)
extraction("e4_extract_yield_json", YIELD, e.yield_json)
extraction("e5_extract_share_class_json", SHARE_CLASS, e.share_class_json)
extraction("e5_extract_issuer_json", ISSUER, e.issuer_json)
extraction("e5_extract_reserves_json", RESERVES, e.reserves_json)
extraction("e6_extract_identifiers_text", IDS_TEXT, e.cusip_text, e.isin_text)
extraction("e7_extract_nav_text", NAV_PROSE, e.nav_text)
extraction("e8_extract_share_class_text", CLASS_PROSE, e.share_class_text)


@query("e9_extract_claims", f"WITH {SPLIT} {ALL_CLAIMS}")
def extract_claims(t):
    return e.extract_claims(t.documents)


@query("b6_identifier_candidates", f"""WITH {SPLIT}, found AS ({ALL_CLAIMS})
SELECT subject, property || ':' || value_str AS candidate FROM found
WHERE property IN ('cusip', 'isin', 'ticker', 'lei', 'cik') AND value_str IS NOT NULL""")
def identifier_candidates(t):
    return lookups.identifier_candidates(e.extract_claims(t.documents))


def term(kind_, type_, terms, confidence, holder="NULL", transfer="NULL", window="NULL", source="j", where="true"):
    prefix = "right" if kind_ == "RIGHT" else "rest"
    return f"""SELECT subject, snapshot_id, evidence_id, '{kind_}' AS kind, '{type_}' AS type, CAST({holder} AS VARCHAR) AS holder_type,
      CAST({terms} AS VARCHAR) AS terms, CAST({transfer} AS VARCHAR) AS transferability, CAST({window} AS VARCHAR) AS redemption_window,
      CAST({confidence} AS DOUBLE) AS confidence, '{prefix}:prop:' || subject || ':{type_.lower()}:' || snapshot_id AS id
      FROM {source} WHERE {where}"""


LOCKED = "coalesce(json_extract_string(body, '$.transferable') = 'false', false)"


def inner(key):
    pick = f"CASE WHEN coalesce({kind('redemption')}, 'NULL') <> 'NULL' THEN 'redemption' ELSE 'liquidity' END"
    return " ".join(f"WHEN '{o}' THEN {text(o + '.' + key)}" for o in ("redemption", "liquidity")).join([f"CASE {pick} ", " END"])


WINDOW = f"coalesce({text('redemptionWindow')}, {inner('window')}, {inner('frequency')}, 'daily')"
REDEMPTION = term(
    "RIGHT", "REDEMPTION", f"coalesce({inner('terms')}, 'Notice period: ' || {inner('noticePeriod')}, 'Redemption window: ' || {WINDOW})", "0.95",
    f"CASE WHEN json_extract_string(body, '$.beneficialOwnership') = 'true' THEN 'BENEFICIAL_OWNER' ELSE 'TOKEN_HOLDER' END",
    f"CASE WHEN {LOCKED} OR coalesce(json_extract_string(body, '$.redemption.transferable') = 'false', false) THEN 'RESTRICTED' ELSE 'TRANSFERABLE' END",
    WINDOW, where=f"{truthy('redemption')} OR {truthy('liquidity')} OR {truthy('redemptionWindow')}")
INCOME = term("RIGHT", "INCOME", f"coalesce({text('distribution.terms')}, '{X.INCOME_TERMS}')", "0.92", "'TOKEN_HOLDER'",
              f"CASE WHEN {LOCKED} THEN 'RESTRICTED' ELSE 'TRANSFERABLE' END",
              where=" OR ".join(truthy(k) for k in ("distribution", "yield", "coupon", "yieldBps")))
RESTRICTIONS = term(
    "RESTRICTION", "ELIGIBILITY", f"coalesce({text('eligibility.criteria')}, {text('investorType')}, CASE WHEN json_extract_string(body, '$.kycRequired') = 'true' THEN '{X.KYC_CRITERIA}' ELSE '{X.OTHER_CRITERIA}' END)",
    "0.95", where=" OR ".join(truthy(k) for k in ("eligibility", "investorType", "kycRequired")),
) + " UNION ALL " + term(
    "RESTRICTION", "JURISDICTION", f"coalesce({text('jurisdiction')}, CASE WHEN {kind('excludedJurisdictions')} = 'ARRAY' THEN 'Excluded: ' || array_to_string(CAST(json_extract(body, '$.excludedJurisdictions') AS VARCHAR[]), ', ') END, '{X.JURISDICTION_DEFAULT}')",
    "0.95", where=" OR ".join(truthy(k) for k in ("jurisdiction", "jurisdictionRestrictions", "excludedJurisdictions")))
REDEMPTION_PROSE = term(
    "RIGHT", "REDEMPTION", "m", "0.88", "CASE WHEN contains(low, 'beneficial owner') THEN 'BENEFICIAL_OWNER' ELSE 'TOKEN_HOLDER' END",
    "CASE WHEN contains(low, 'non-transferable') THEN 'NON_TRANSFERABLE' ELSE 'RESTRICTED' END", "m",
    source=f"(SELECT *, regexp_extract(body, '{X.REDEMPTION_TEXT}', 1) AS g, trim(regexp_extract(body, '{X.REDEMPTION_TEXT}', 1), ' \t\n\r\f') AS m FROM p) x",
    where="g <> '' AND lower(m) <> 'terms' AND NOT contains(low, 'without redemption') AND NOT contains(low, 'no redemption')")
RESTRICTIONS_PROSE = term(
    "RESTRICTION", "ELIGIBILITY", f"CASE WHEN contains(low, 'qualified purchaser') THEN '{X.QUALIFIED_PURCHASER}' ELSE '{X.ACCREDITED_INVESTOR}' END",
    "0.95", source="p", where="contains(low, 'qualified purchaser') OR contains(low, 'accredited investor')",
) + " UNION ALL " + term(
    "RESTRICTION", "JURISDICTION", f"'{X.REGULATION_S}'", "0.95", source="p",
    where="contains(low, 'regulation s') OR contains(low, 'non-us persons only')")
ALL_TERMS = " UNION ALL ".join([REDEMPTION, INCOME, RESTRICTIONS, REDEMPTION_PROSE, RESTRICTIONS_PROSE])


def interpretation(name: str, oracle: str, *extractors):
    @query(name, f"WITH {SPLIT} {oracle}")
    def run(t):
        return e.extract_terms(t.documents, list(extractors))

    return run


interpretation("r1_rights_redemption_json", REDEMPTION, e.redemption_json)
interpretation("r2_rights_income_json", INCOME, e.income_json)
interpretation("r3_restrictions_json", RESTRICTIONS, e.eligibility_json, e.jurisdiction_json)
interpretation("r4_rights_redemption_text", REDEMPTION_PROSE, e.redemption_text)
interpretation("r5_restrictions_text", RESTRICTIONS_PROSE, e.eligibility_text, e.jurisdiction_text)

MISSING = """SELECT DISTINCT 'issue:unresolved:' || subject || ':redemption' AS id, subject, 'EVIDENCE_MISSING' AS issue_type,
  'redemptionTerms' AS dimension FROM docs WHERE subject NOT IN (SELECT subject FROM terms WHERE type = 'REDEMPTION')"""


@query("r6_missing_redemption", f"WITH {SPLIT}, terms AS ({ALL_TERMS}) {MISSING}")
def missing_redemption(t):
    docs = t.documents
    return e.missing_redemption(docs, e.extract_terms(docs))


@query("r7_interpret_rights", f"""WITH {SPLIT}, terms AS ({ALL_TERMS})
SELECT * FROM terms UNION ALL
SELECT subject, NULL, NULL, 'ISSUE', issue_type, NULL, NULL, NULL, NULL, NULL, id FROM ({MISSING}) m""")
def interpret_rights(t):
    return e.interpret_rights(t.documents)
