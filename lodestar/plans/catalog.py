"""All queries of the library."""

from lodestar.plans import answers, chains, content, corpus, documents, ingest, intents, knowledge, retrieval, routes  # noqa: F401  they register their queries
from lodestar.plans.registry import QUERIES, SQL
