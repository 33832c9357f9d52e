"""The registered queries of the reference's operators and their SQL."""

from __future__ import annotations

from tidemark.plans import queries_audits, queries_events, queries_evidence, queries_farms, queries_reports, queries_sources, queries_streams  # noqa: F401
from tidemark.plans.register import ORACLE, QUERIES  # noqa: F401
