"""Registered queries, grouped by area; importing the package fills the registry."""

from . import (  # noqa: F401
    ingest_plans,
    quality_plans,
    lookup_plans,
    reference_plans,
    verify_plans,
    mandate_plans,
    lineage_plans,
    status_plans,
    version_plans,
    document_plans,
    relation_plans,
    conflict_plans,
    promotion_plans,
    digest_plans,
    history_plans,
    whole_plans,
    log_plans,
    stream_plans,
    design_plans,
)
