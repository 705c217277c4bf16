"""All registered queries (importing a plan module registers its queries)."""

from corpusmill.plans import q_pages, q_records, q_runs, q_sampling, q_scores, q_sequences, q_store, q_vectors, q_vocab  # noqa: F401
from corpusmill.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
