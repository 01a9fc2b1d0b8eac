"""The dashboard, the address page and retrieval, as sets of DataFrames."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from ..operators.catalog import recent_files
from ..operators.ips import (
    ip_actions,
    ip_contacts,
    ip_dst_ports,
    ip_profile,
    ip_records,
    ip_risk,
    ip_src_ports,
)
from ..operators.knn import knn_search
from ..operators.reports import evidence_payload
from ..operators.stats import (
    action_dist,
    dashboard_totals,
    protocol_dist,
    top_dst_ports,
    top_src_ips,
)
from ..operators.vectors import embed_messages
from ..schema import SEARCH_K


def dashboard(logs: DataFrame, files: DataFrame, history: DataFrame) -> dict[str, DataFrame]:
    """All parts of the overview; ``files`` is an inventory with ``indexed``.

    ``dashboard_cube`` gives the four distributions from one scan instead.
    """
    return {
        "totals": dashboard_totals(logs, files, history),
        "protocol_dist": protocol_dist(logs),
        "action_dist": action_dist(logs),
        "top_src_ips": top_src_ips(logs),
        "top_dst_ports": top_dst_ports(logs),
        "recent_files": recent_files(files),
    }


def ip_detail(logs: DataFrame, ip: str | None = None) -> dict[str, DataFrame]:
    """Everything known about one address, or about all of them."""
    return {
        "profile": ip_profile(logs, ip),
        "actions": ip_actions(logs, ip),
        "dst_ports": ip_dst_ports(logs, ip),
        "src_ports": ip_src_ports(logs, ip),
        "contacts": ip_contacts(logs, ip),
        "records": ip_records(logs, ip),
        "risk": ip_risk(logs, ip),
    }


def semantic_search(
    vectors: DataFrame, queries: DataFrame, model: PipelineModel, k: int = SEARCH_K
) -> DataFrame:
    """Records nearest in meaning to each text; ``queries`` has ``query_id, query``."""
    return knn_search(vectors, embed_messages(queries, model, "query"), k)


def retrieve_evidence(
    vectors: DataFrame, queries: DataFrame, model: PipelineModel, k: int = SEARCH_K
) -> DataFrame:
    """Per question the evidence a report writer needs, as JSON."""
    return evidence_payload(semantic_search(vectors, queries, model, k), queries)
