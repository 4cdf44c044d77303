"""G1 without writing the candidates out: a rank join.

A candidate is an offer (a course and a teacher, with a score) at a place (a
room of the offer's pool, at a slot). Candidates rank by score, then by a hash
of their keys. Offers are few, candidates are offers x places; so the offers are
taken in rank order, a slice at a time, and only a slice's offers are expanded,
with the places that are still open. A decision depends only on candidates
ranked before it, so a slice settles as the sequential walk would; what it takes
closes places, and the offers of served courses and full pools are never
expanded at all.

A slice holds about ``factor`` candidates for each open place. Offers of one
score go together; where one score alone has far more candidates than that (all
scores null, say), its candidates are taken by ranges of the hash.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semestra.operators.greedy import _rounds, _State, _union, finish, rank_key, score_order
from semestra.session import drop_written, materialize

log = logging.getLogger(__name__)

FACTOR = 16  # candidates of the first slice for each open place
FILE_ROWS = 50_000  # candidates of a slice for each of its files


def rank_join_select(offers: DataFrame, places: DataFrame, on: Sequence[str], course_cols: Sequence[str],
                     teacher_col: str, room_col: str, slot_col: str, score_col: str, capacity_col: str,
                     demand_col: str, busy: DataFrame | None = None, max_sections: int | None = None,
                     factor: int = FACTOR, max_rounds: int = 100_000) -> tuple[DataFrame, int]:
    """Greedy selection over ``offers`` joined with ``places`` on ``on``.

    ``offers``: course columns, teacher, score, demand, ``on`` and any payload;
    ``places``: room, slot, capacity, ``on``, one row each. ``on`` may hold the
    slot where offers are scored by slot. ``busy`` (teacher, slot) are taken from the start.

    Returns (accepted rows with ``seats``, ``round`` and ``_ord``; rounds): the
    rows ``greedy_select`` gives for the whole join.
    """
    spark = offers.sparkSession
    scratch: list[str] = []
    course_cols, on = list(course_cols), list(on)
    keys = [*course_cols, teacher_col, room_col, slot_col]
    ts_keys, rs_keys = [teacher_col, slot_col], [room_col, slot_col]
    offers = materialize(offers.withColumn("_s", score_order(score_col)), "offers", scratch)
    places = materialize(places, "places", scratch)
    courses = materialize(offers.groupBy(*course_cols).agg(F.max(demand_col).cast("long").alias("_remaining")),
                          "courses", scratch)
    state = _State(courses, scratch)
    taken = materialize(busy.select(*ts_keys).distinct(), "busy", scratch) if busy is not None else None
    shape = offers.join(places, on).withColumn("_rk", rank_key(score_col, keys)).drop("_s")
    done = (float("-inf"), 1.0)  # everything up to this score, and share of the hashes of that score
    while max_sections is None or state.n_accepted < max_sections:
        open_places = places
        if state.accepted:
            open_places = places.join(_union(state.accepted).select(*rs_keys), rs_keys, "left_anti")
        wanted = state.remaining(course_cols).where("_remaining > 0").select(*course_cols)
        open_offers = offers.join(wanted, course_cols, "left_semi")
        behind = F.col("_s") > F.lit(done[0])
        if done[1] < 1:
            behind = behind | (F.col("_s") == F.lit(done[0]))
        per_pool = open_places.groupBy(*on).agg(F.count(F.lit(1)).alias("_w"))
        weighed = open_offers.where(behind).join(per_pool, on)
        goal = factor * open_places.count()
        until = _bound(weighed.select("_s", "_w"), done, goal)
        if until is None:
            break
        # The slice: offers up to the bound at open places, by hash at its ends.
        part = open_offers.where(behind & (F.col("_s") <= F.lit(until[0]))).join(open_places, on)
        part = part.withColumn("_rk", rank_key(score_col, keys))
        share = F.conv(F.substring("_rk.h", 1, 8), 16, 10).cast("double") / float(1 << 32)
        if done[1] < 1:
            part = part.where((F.col("_s") > F.lit(done[0])) | (share >= F.lit(done[1])))
        if until[1] < 1:
            part = part.where((F.col("_s") < F.lit(until[0])) | (share < F.lit(until[1])))
        for gone in ([taken] if taken is not None else []) + ([_union(state.accepted)] if state.accepted else []):
            part = part.join(gone.select(*ts_keys), ts_keys, "left_anti")
        # A round reads the slice several times: as many files as its rows need.
        part = materialize(part.drop("_s").repartition(1 + goal // FILE_ROWS, *ts_keys), "slice", scratch)
        state.payload.append(part)
        _rounds(state, part, course_cols, teacher_col, room_col, slot_col, "_rk", capacity_col, max_sections, max_rounds)
        log.info("rank join up to %s: %d accepted after %d rounds", until, state.n_accepted, state.rounds)
        done = until
        factor *= 2
    out = finish(state, shape, "_rk", max_sections)
    drop_written(spark, scratch)
    return out, state.rounds


def _bound(weighed: DataFrame, done: tuple[float, float], goal: int) -> tuple[float, float] | None:
    """The rank up to which about ``goal`` candidates follow ``done``: a score
    and the share of its hashes; None where no candidate follows."""
    left = 1 - done[1]
    weight = F.col("_w") * F.when(F.col("_s") == F.lit(done[0]), F.lit(left)).otherwise(F.lit(1.0))
    total = weighed.agg(F.sum(weight).alias("n"), F.max("_s").alias("last")).first()
    if not total["n"]:
        return None
    if total["n"] <= goal:
        return total["last"], 1.0
    at = weighed.agg(F.percentile_approx("_s", max(goal / total["n"], 1e-6), 100_000)).first()[0]
    below, same = weighed.agg(F.sum(F.when(F.col("_s") < F.lit(at), weight)), F.sum(F.when(F.col("_s") == F.lit(at), F.col("_w")))).first()
    since = done[1] if at == done[0] and done[1] < 1 else 0.0
    room = goal - (below or 0)
    share = since + max(room, goal / 4) / same
    return (at, 1.0) if share >= 0.5 else (at, share)
