"""All queries of the reference's operators, by family."""

from __future__ import annotations

from folioscope.plans import bags, contracts, datasets, decisions, gates, geometry, joins, ordered, python_backed, summaries, texts, validators  # noqa: F401
from folioscope.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
