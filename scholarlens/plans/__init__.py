"""Named queries, each kept beside the SQL that states the same result."""

from scholarlens.plans import corpus, fitting, geography, summaries, topics  # noqa: F401
from scholarlens.plans.registry import ORACLES, QUERIES  # noqa: F401
