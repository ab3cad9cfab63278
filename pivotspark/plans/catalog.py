"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from . import q_decomp, q_ext, q_gate, q_labels, q_nie, q_probes, q_runs, q_sources, q_text, q_train, q_vectors  # noqa: F401
from .q_train import flagship
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE", "flagship"]
