"""Relationships over whole tables of pairs."""

from pyspark.sql import functions as F

from ..operators import relate as r
from .registry import query

PAIRED = """paired AS (
  SELECT p.a_id, p.b_id, a.issuer AS ai, b.issuer AS bi, a.cusip AS ac, b.cusip AS bc, a.isin AS an, b.isin AS bn,
         a.share_class AS ash, b.share_class AS bsh, a.asset_class AS aa, b.asset_class AS ba, a.ticker AS atk, b.ticker AS btk,
         a.bridge_mechanism AS ab, b.bridge_mechanism AS bb, a.is_wrapped AS aw, b.is_wrapped AS bw, a.parent AS ap, b.parent AS bp,
         a.relationship AS ar, b.relationship AS br, a.redemption_terms AS art, b.redemption_terms AS brt,
         a.evidence_refs AS ae, b.evidence_refs AS be
  FROM b_pairs p JOIN b_profiles a ON p.a_id = a.id JOIN b_profiles b ON p.b_id = b.id)"""
SAME_FUND = "(coalesce(lower(ai) = lower(bi), false) OR coalesce(ac = bc, false))"
APART = f"({SAME_FUND} AND coalesce(lower(ash) <> lower(bsh), false))"
OTHER_ISSUER = "coalesce(lower(ai) <> lower(bi), false)"


def rel(name, predicate, confidence, equivalent, where):
    return f"""SELECT 'rel:prop:' || a_id || ':{name}:' || b_id AS id, a_id AS subject, '{predicate}' AS predicate, b_id AS object,
      CAST({confidence} AS DOUBLE) AS confidence, {equivalent} AS is_equivalent,
      array_to_string(list_sort(list_distinct(list_concat(ae, be))), ',') AS evidence_refs FROM paired WHERE {where}"""


BRIDGED = rel("bridged", "BRIDGED_REPRESENTATION_OF", 0.98, "true", "ab IS NOT NULL OR bb IS NOT NULL") + " UNION ALL " + rel(
    "equiv", "ECONOMICALLY_EQUIVALENT_TO", 0.99, "true",
    f"(ab IS NOT NULL OR bb IS NOT NULL) AND {SAME_FUND} AND coalesce(lower(ash) = lower(bsh), true)")
WRAPPED = rel("wrapped", "WRAPPED_REPRESENTATION_OF", 0.98, "true", "aw OR bw")
CLASSES = rel("shareClass", "SHARE_CLASS_OF", 0.96, "false", APART) + " UNION ALL " + rel("similar", "SIMILAR_EXPOSURE_TO", 0.95, "false", APART)
EXPOSURE = f"{OTHER_ISSUER} AND coalesce(lower(aa) = lower(ba), false)"
SIMILAR = rel("similar", "SIMILAR_EXPOSURE_TO", 0.92, "false", EXPOSURE)


def issue(name, kind, where):
    return f"""SELECT a_id AS subject, 'issue:unresolved:' || a_id || ':' || b_id || ':{name}' AS id, '{kind}' AS issue_type,
      '{name}' AS dimension FROM paired WHERE {where}"""


GAP = issue("identifiers", "IDENTITY_AMBIGUOUS", "coalesce(ac, an, ai) IS NULL OR coalesce(bc, bn, bi) IS NULL")
COLLISION = issue("tickerCollision", "RELATIONSHIP_AMBIGUOUS", f"upper(atk) = upper(btk) AND {OTHER_ISSUER}")


def paired(t):
    return r.representation_pairs(t.pairs, t.profiles)


def flat(df):
    """Refs as sorted text, for comparison."""
    return df.withColumn("evidence_refs", F.array_join(F.array_sort("evidence_refs"), ","))


@query("c13_representation_pairs", f"WITH {PAIRED} SELECT a_id, b_id, ai AS issuer_a, bi AS issuer_b, aa AS class_a, ba AS class_b FROM paired")
def representation_pairs(t):
    return paired(t).select(
        "a_id", "b_id", F.col("a.issuer").alias("issuer_a"), F.col("b.issuer").alias("issuer_b"),
        F.col("a.asset_class").alias("class_a"), F.col("b.asset_class").alias("class_b"),
    )


@query("c14_parent_link", """
WITH linked AS (SELECT p.id AS parent, c.id AS child FROM b_profiles c JOIN b_profiles p ON c.parent = p.id
                WHERE c.relationship = 'BRIDGED_REPRESENTATION_OF')
SELECT parent AS a_id, child AS b_id FROM linked UNION ALL SELECT child, parent FROM linked""")
def parent_link(t):
    return r.parent_link(t.profiles)


@query("u2_ref_union", f"WITH {PAIRED} SELECT a_id, b_id, array_to_string(list_sort(list_distinct(list_concat(ae, be))), ',') AS evidence_refs FROM paired")
def ref_union(t):
    return flat(paired(t).select("a_id", "b_id", r.ref_union().alias("evidence_refs")))


@query("g1_rel_identifier_gap", f"WITH {PAIRED} {GAP}")
def rel_identifier_gap(t):
    return r.rel_identifier_gap(paired(t))


@query("g2_rel_bridged", f"WITH {PAIRED} {BRIDGED}")
def rel_bridged(t):
    return flat(r.rel_bridged(paired(t)))


@query("g3_rel_wrapped", f"WITH {PAIRED} {WRAPPED}")
def rel_wrapped(t):
    return flat(r.rel_wrapped(paired(t)))


@query("g4_rel_share_class", f"WITH {PAIRED} {CLASSES}")
def rel_share_class(t):
    return flat(r.rel_share_class(paired(t)))


@query("g5_rel_similar_exposure", f"WITH {PAIRED} {SIMILAR}")
def rel_similar_exposure(t):
    return flat(r.rel_similar_exposure(paired(t)))


@query("g6_rel_ticker_collision", f"WITH {PAIRED} {COLLISION}")
def rel_ticker_collision(t):
    return r.rel_ticker_collision(paired(t))


@query("g7_classify_relationships", f"WITH {PAIRED} {BRIDGED} UNION ALL {WRAPPED} UNION ALL {CLASSES} UNION ALL "
       + rel("similar", "SIMILAR_EXPOSURE_TO", 0.92, "false", f"{EXPOSURE} AND NOT {APART}"))
def classify_relationships(t):
    return flat(r.classify_relationships(paired(t)))


@query("g7_relationship_issues", f"WITH {PAIRED} {GAP} UNION ALL {COLLISION}")
def relationship_issues(t):
    return r.relationship_issues(paired(t))


@query("g8_semantic_compare", f"""WITH {PAIRED},
compared AS (SELECT a_id, b_id, coalesce(ash <> bsh, false) AS d1, coalesce(ai <> bi, false) AS d2, coalesce(art <> brt, false) AS d3,
  coalesce(bp = a_id AND br = 'BRIDGED_REPRESENTATION_OF', false) OR coalesce(ap = b_id AND ar = 'BRIDGED_REPRESENTATION_OF', false) AS linked FROM paired)
SELECT a_id, b_id, CASE WHEN linked AND NOT d1 THEN 'ECONOMICALLY_EQUIVALENT_TO' WHEN d1 OR d2 OR d3 THEN 'SIMILAR_EXPOSURE_TO' ELSE 'REPRESENTS' END AS relationship,
       linked AND NOT d1 AS is_equivalent,
       CASE WHEN linked AND NOT d1 THEN '' ELSE concat_ws(',', CASE WHEN d1 THEN 'share_class' END, CASE WHEN d2 THEN 'issuer' END,
            CASE WHEN d3 THEN 'redemption_terms' END) END AS differences FROM compared""")
def semantic_compare(t):
    return r.semantic_compare(paired(t)).withColumn("differences", F.array_join("differences", ","))
