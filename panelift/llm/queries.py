"""All queries of the subpackage: importing a module registers its queries."""

from panelift.llm import clusters, decontaminate, licenses, lines, nearjoin, periods, private, quality, secrets, suffixes, tokenize, topk, urls  # noqa: F401
from panelift.llm.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
