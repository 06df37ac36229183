"""Fixed values of the data model: enumerations, orders of precedence and default texts."""

# --- fixed values: enumerations -------------------------------------------------------
CLAIM_STATES = [
    "UNKNOWN", "OBSERVED", "SOURCED", "ATTESTED", "VERIFIED",
    "INFERRED", "CONFLICTING", "STALE", "REVOKED",
]
EVIDENCE_TYPES = [
    "DOCUMENT", "ORACLE", "ONCHAIN_STATE", "ATTESTATION",
    "API_RESPONSE", "FILING", "PROOF", "OTHER",
]
EVIDENCE_AUTHORITIES = [
    "PRIMARY_SOURCE", "AUTHORIZED_ATTESTOR", "ONCHAIN_STATE", "INDEPENDENT_ORACLE",
    "REFERENCE_DATA", "MARKET_DATA", "DERIVED", "AI_INFERENCE", "DEMO_FIXTURE",
]
FRESHNESS = ["FRESH", "STALE", "UNKNOWN"]
OUTCOMES = ["PASS", "FAIL", "UNRESOLVED"]
OBJECT_STATES = [
    "RESOLVED", "PARTIALLY_RESOLVED", "CONFLICTING", "STALE",
    "INSUFFICIENT_EVIDENCE", "REVOKED", "UNSUPPORTED",
]
PREDICATES = [
    "REPRESENTS", "BRIDGED_REPRESENTATION_OF", "WRAPPED_REPRESENTATION_OF", "SHARE_CLASS_OF",
    "CLAIM_ON", "ISSUED_BY", "BACKED_BY", "CUSTODIED_BY", "REDEEMABLE_FOR", "DERIVATIVE_OF",
    "COLLATERALIZED_BY", "GUARANTEED_BY", "FUNCTIONALLY_FUNGIBLE_WITH",
    "ECONOMICALLY_EQUIVALENT_TO", "SIMILAR_EXPOSURE_TO", "SUPERSEDES",
]
EXCEPTION_TYPES = [
    "EVIDENCE_STALE", "EVIDENCE_CONFLICT", "EVIDENCE_MISSING", "IDENTITY_AMBIGUOUS",
    "RELATIONSHIP_AMBIGUOUS", "ATTESTATION_REVOKED", "SOURCE_FAILURE", "VERIFICATION_FAILED",
    "POLICY_AMBIGUOUS", "UNSUPPORTED_REPRESENTATION",
]
SEVERITIES = ["INFO", "WARNING", "BLOCKING"]
EXCEPTION_STATUSES = ["OPEN", "RESOLVED", "SUPERSEDED", "WAIVED"]
ATTESTATION_STATES = ["ACTIVE", "EXPIRED", "REVOKED"]
IDENTIFIER_SCHEMES = ["CAIP19", "DTI", "ISIN", "CUSIP", "CONTRACT", "ISSUER", "CUSTOM"]
ENVIRONMENTS = ["EVM", "SOLANA", "CANTON", "OFFCHAIN", "OTHER"]
REPRESENTATION_STATUSES = ["ACTIVE", "SUSPENDED", "REVOKED", "UNKNOWN"]
HOLDER_TYPES = ["LEGAL_OWNER", "BENEFICIAL_OWNER", "RECORD_HOLDER", "TOKEN_HOLDER"]
RIGHT_TYPES = ["REDEMPTION", "INCOME", "VOTING", "INFORMATION", "CONVERSION", "OTHER"]
TRANSFERABILITY = ["TRANSFERABLE", "RESTRICTED", "NON_TRANSFERABLE"]
RESTRICTION_TYPES = ["ELIGIBILITY", "JURISDICTION", "LOCKUP", "TRANSFER_RESTRICTION", "SANCTION"]
CONFLICT_CAUSES = [
    "EFFECTIVE_DATE_MISMATCH", "SHARE_CLASS_MISMATCH", "REPRESENTATION_MISMATCH",
    "JURISDICTION_MISMATCH", "STALE_SOURCE", "UNKNOWN_AUTHORITY", "OTHER",
]
RUN_STATUSES = ["SUCCESS", "REJECTED_MALFORMED", "REJECTED_TIMEOUT", "REJECTED_SECURITY"]
CHANGE_TYPES = [
    "EVIDENCE_REVOKED", "EVIDENCE_STALE", "EVIDENCE_CONFLICT",
    "SOURCE_UPDATED", "ATTESTATION_REVOKED", "MANUAL_REFRESH",
]
VALID_CHAIN_IDS = [1952, 196]
IDENTIFIER_PROPERTIES = ["cusip", "isin", "ticker", "lei", "cik"]
AUTHORITATIVE = ["PRIMARY_SOURCE", "REFERENCE_DATA", "ONCHAIN_STATE", "AUTHORIZED_ATTESTOR"]

# --- fixed values: patterns -----------------------------------------------------------
HEX = r"^0x[0-9a-fA-F]+$"
HEX_32_BYTES = r"^0x[0-9a-fA-F]{64}$"
SIGNATURE = r"^0x[0-9a-fA-F]{130}$"
ZERO_ROOT = "0x" + "0" * 64
URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^\s/?#]+[^\s]*$"
# Word boundaries are written out: `\b` means different things in different regex engines.
CUSIP_TEXT = r"(?i)(?:\A|[^A-Za-z0-9_])CUSIP\s*(?:#|No\.?|:)?\s*([0-9A-Z]{9})(?:[^A-Za-z0-9_]|\z)"
ISIN_TEXT = r"(?i)(?:\A|[^A-Za-z0-9_])ISIN\s*(?:#|No\.?|:)?\s*([A-Z]{2}[0-9A-Z]{10})(?:[^A-Za-z0-9_]|\z)"
NAV_TEXT = r"(?i)(?:Net Asset Value|NAV)\s*(?:of|is|:)?\s*\$?([0-9]+\.[0-9]+)\s*(USD|EUR)?"
SHARE_CLASS_TEXT = r"(?i)(?:Share Class|Class|Series)\s*(?:is|:)?\s*(Institutional|Retail|Class A|Class B|Founder)"
REDEMPTION_TEXT = (
    r"(?i)redemption(?:\s+window|\s+frequency|\s+period)?\s*(?:is|:)\s*"
    r"([A-Za-z0-9\+\s\-]+?(?:\.|\n|;|\z))"
)
NUMERIC_TEXT = r"^\s*[+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"

# --- fixed values: default texts ------------------------------------------------------
INCOME_TERMS = "Yield accrual and distribution terms per fund prospectus"
KYC_CRITERIA = "KYC/AML approval and whitelist required"
OTHER_CRITERIA = "Restricted investor category"
JURISDICTION_DEFAULT = "Jurisdictional scope limited"
QUALIFIED_PURCHASER = "Qualified Purchaser (QP) under Section 3(c)(7)"
ACCREDITED_INVESTOR = "Accredited Investor under Regulation D"
REGULATION_S = "Non-US (Regulation S)"

# --- fixed values: legal moves between claim states ------------------------------------
LEGAL_MOVES = [
    ("UNKNOWN", "SOURCED"), ("UNKNOWN", "OBSERVED"), ("UNKNOWN", "INFERRED"),
    ("SOURCED", "ATTESTED"), ("OBSERVED", "ATTESTED"), ("ATTESTED", "VERIFIED"),
    ("SOURCED", "STALE"), ("ATTESTED", "STALE"), ("VERIFIED", "STALE"),
    ("ATTESTED", "REVOKED"), ("VERIFIED", "REVOKED"),
    ("SOURCED", "CONFLICTING"), ("ATTESTED", "CONFLICTING"), ("VERIFIED", "CONFLICTING"),
]

# --- fixed values: gate thresholds (metric, bound, kind) ------------------------------
GATE_THRESHOLDS = [
    ("false_equivalence_rate", 0.0, "max"),
    ("false_allow_rate", 0.0, "max"),
    ("unsupported_inference_rate", 0.0, "max"),
    ("claim_accuracy", 0.95, "min"),
    ("rights_accuracy", 0.95, "min"),
    ("relationship_accuracy", 0.95, "min"),
    ("conflict_recall", 0.95, "min"),
]

# --- engine versions and digest domains (our own) -------------------------------------
VERIFIER_VERSION = "veritab-verifier-v1"
POLICY_VERSION = "veritab-policy-v1"
HASHING_VERSION = "veritab-hashing-v1"
LEAF_DOMAIN = "veritab:evidence-leaf:v1"
TREE_DOMAIN = "veritab:evidence-tree:v1"
OBJECT_DOMAIN = "veritab:object:v1"
PROPOSAL_DOMAIN = "veritab:proposal:v1"
NODE_DOMAIN = "veritab:object-node:v1"
WHOLE_DOMAIN = "veritab:whole-object:v1"

# --- binding parameters ----------------------------------------------------------------
NOW_MS = 1009756800000        # 2001-12-31T00:00:00Z
MAX_AGE_MS = 201600000000     # 2,333 days: ship dates before mid-August 1995 are too old
EVENT_NOW_MS = 1706659200000  # 2024-01-31T00:00:00Z
