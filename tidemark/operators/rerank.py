"""Order-dependent reranking of a run's candidates: diversity caps over a sliding window, then exploration slots.

Each choice depends on those before it, so a run is worked through in Python; runs are bounded (MOST candidates, by rank)
and independent, so Spark deals them out by run.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("duplicate_group", "author_id", "region_id", "theme")
MOST = 100
OUT = "run_id long, post_id long, base_rank int, rank int, reason string, relaxed string"
EXPLORED = "run_id long, post_id long, rank int, origin string"


@dataclass(frozen=True)
class Diversity:
    """Caps per dimension within `window` positions, and how far a candidate may move."""

    window: int = 10
    promotion: int = 8
    demotion: int = 8
    caps: tuple[int, ...] = (1, 2, 4, 3)
    relaxation: tuple[str, ...] = ("theme", "region_id", "author_id", "duplicate_group")


SLOTS = (6, 16)


def _over(keys: tuple, recent: list[tuple], caps: tuple[int, ...]) -> set[str]:
    """Dimensions whose cap the candidate would exceed after the recent ones."""
    return {d for k, (d, cap) in enumerate(zip(DIMENSIONS, caps, strict=True)) if keys[k] is not None and sum(r[k] == keys[k] for r in recent) >= cap}


def diversify(candidates: list[tuple], policy: Diversity, forced_must_fit: bool = False) -> list[tuple[int, str, str]]:
    """Indexes of candidates (their dimension keys, by base rank) in new order, with reason and relaxed dimensions.

    forced_must_fit: a candidate that may fall no further still has to fit, relaxing caps for it alone; otherwise it is
    taken as it is.
    """
    left, chosen, recent = list(range(len(candidates))), [], []
    for position in range(1, len(candidates) + 1):
        window = recent[-(policy.window - 1) :] if policy.window > 1 else []
        overdue = [i for i in left if i + 1 <= position - policy.demotion][:1]
        if overdue and not forced_must_fit:
            pick, reason, relaxed = overdue[0], "FORCED", []
        else:
            pool = overdue or [i for i in left if i + 1 <= position + policy.promotion]
            over = {i: _over(candidates[i], window, policy.caps) for i in pool}
            relaxed, pick = [], None
            for n in range(len(policy.relaxation) + 1):
                relaxed = list(policy.relaxation[:n])
                pick = next((i for i in pool if over[i] <= set(relaxed)), None)
                if pick is not None:
                    break
            reason = "FORCED" if overdue else "RELAXED" if relaxed else "BASE" if pick == left[0] else "DIVERSE"
        left.remove(pick)
        recent.append(candidates[pick])
        chosen.append((pick, reason, ",".join(relaxed)))
    return chosen


def explore(ranked: list[tuple], pool: list[tuple], policy: Diversity, slots: tuple[int, ...] = SLOTS) -> list[tuple[str, int]]:
    """(origin, index) in final order: at each slot the first of the pool whose keys keep their caps in every window around it."""
    order = [("PERSONALIZED", i) for i in range(len(ranked))]
    used: set[int] = set()
    keys = lambda x: ranked[x[1]] if x[0] == "PERSONALIZED" else pool[x[1]]
    for slot in slots:
        if len(order) < slot - 1:
            continue
        for j in (j for j in range(len(pool)) if j not in used):
            trial = [*order[: slot - 1], ("EXPLORATION", j), *order[slot - 1 :]]
            windows = [trial[max(0, s) : s + policy.window] for s in range(slot - policy.window, slot)]
            if all(
                sum(keys(x)[k] == pool[j][k] for x in w) <= cap for w in windows for k, cap in enumerate(policy.caps) if pool[j][k] is not None
            ):
                order = trial
                used.add(j)
                break
    return order


def _keys(frame: pd.DataFrame) -> list[tuple]:
    return [tuple(None if pd.isna(v) else v for v in row) for row in frame[list(DIMENSIONS)].itertuples(index=False)]


def rerank(candidates: DataFrame, policy: Diversity = Diversity(), forced_must_fit: bool = False) -> DataFrame:
    """candidates: run_id, post_id, base_rank and DIMENSIONS; at most MOST per run are considered."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["base_rank", "post_id"]).reset_index(drop=True)
        chosen = diversify(_keys(frame), policy, forced_must_fit)
        picked = frame.iloc[[i for i, _, _ in chosen]]
        return pd.DataFrame(
            {"run_id": picked["run_id"].values, "post_id": picked["post_id"].values, "base_rank": [i + 1 for i, _, _ in chosen], "rank": range(1, len(chosen) + 1), "reason": [r for _, r, _ in chosen], "relaxed": [x for _, _, x in chosen]}
        )

    return candidates.filter(F.col("base_rank") <= MOST).groupBy("run_id").applyInPandas(run, OUT)


def insert_exploration(ranked: DataFrame, pool: DataFrame, policy: Diversity = Diversity(), slots: tuple[int, ...] = SLOTS) -> DataFrame:
    """ranked: run_id, post_id, rank and DIMENSIONS; pool: run_id, post_id, place and DIMENSIONS."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values(["rank", "post_id"]), right.sort_values(["place", "post_id"])
        order = explore(_keys(left), _keys(right), policy, slots)
        ids = {"PERSONALIZED": left["post_id"].tolist(), "EXPLORATION": right["post_id"].tolist()}
        run_id = (left if len(left) else right)["run_id"].iloc[0]
        return pd.DataFrame({"run_id": run_id, "post_id": [ids[o][i] for o, i in order], "rank": range(1, len(order) + 1), "origin": [o for o, _ in order]})

    return ranked.groupBy("run_id").cogroup(pool.groupBy("run_id")).applyInPandas(run, EXPLORED)
