"""The registered queries of the reference's operators and their SQL."""

from __future__ import annotations

from . import q_access, q_aggregate, q_artifacts, q_audit, q_compose, q_contract, q_docs, q_filter, q_gates, q_join, q_media, q_order, q_pages, q_provenance, q_scalar, q_seo  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES
