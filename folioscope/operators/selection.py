"""Greedy selection with quotas: a stateful choice inside one group at a time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: what each earlier pick of a page costs a candidate.
PAGE_PENALTY = 0.32


def _choose(pool: pd.DataFrame, quotas: dict[str, int], whole: bool) -> pd.DataFrame:
    pool = pool.sort_values(["page", "line"], kind="stable").reset_index(drop=True)
    cap = max(2, math.ceil(sum(quotas.values()) / max(pool["page"].nunique(), 1)) + 2)
    page_code, _ = pd.factorize(pool["page"])
    taken = np.zeros(page_code.max() + 1 if len(pool) else 0, dtype=np.int64)
    free = np.ones(len(pool), dtype=bool)
    picks: list[tuple[int, str]] = []
    for category, wanted in quotas.items():
        worth = pool["score"].to_numpy() + pool[category].fillna(-np.inf).to_numpy()
        for _ in range(wanted):
            load = taken[page_code]
            open_to = free & (load < cap) & np.isfinite(worth)
            if not open_to.any():
                if whole:
                    raise ValueError(f"the quota of {category} cannot be filled in group {pool['group_id'].iloc[0]}")
                break
            value = np.where(open_to, worth - PAGE_PENALTY * load, -np.inf)
            # among equals: the page with fewer picks, then the earlier page and line (rows are in that order)
            ties = np.flatnonzero(value == value.max())
            best = ties[np.argmin(load[ties])]
            picks.append((best, category))
            free[best] = False
            taken[page_code[best]] += 1
    out = pool.loc[[i for i, _ in picks], ["group_id", "item_id", "page", "line"]].assign(category=[c for _, c in picks], rank=range(1, len(picks) + 1))
    return out


def greedy_quota(df: DataFrame, quotas: dict[str, int], whole: bool = False) -> DataFrame:
    """Picks of each group_id: rows (item_id, page, line, score, and a score or null for each category).

    A group must fit one task; an unfilled quota raises where ``whole`` is set, and gives fewer rows else.
    """
    schema = "group_id string, item_id string, page long, line long, category string, rank int"
    return df.groupBy("group_id").applyInPandas(lambda pool: _choose(pool, quotas, whole), schema)
