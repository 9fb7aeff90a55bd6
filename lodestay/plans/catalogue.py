"""All queries of the engine's own operators."""

from lodestay.plans import addresses, entities, history, listings, operations, places, posts, relational, streams, texts, varied  # noqa: F401
from lodestay.plans.registry import oracle_sql, queries  # noqa: F401
