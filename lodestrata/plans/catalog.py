"""All queries of the package, llm apart."""

from lodestrata.plans import folders, parsing, people, records, scores, search, stores, streams, tables, texts, upkeep  # noqa: F401
from lodestrata.plans.registry import QUERIES, SQL  # noqa: F401
