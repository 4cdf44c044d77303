"""G1: sequential greedy section selection, computed in parallel rounds.

The sequential rule: walk candidates best-first; skip one whose teacher-slot
or room-slot is taken or whose course demand is already seated; otherwise
accept it with ``min(remaining demand, capacity)`` seats; stop after N.

Parallel form (local dominance). In a round, a live candidate is *free* when
it is the first live candidate of its teacher-slot and of its room-slot: no
earlier candidate can take its resources any more. For each course, the free
candidates ranked before the course's first non-free live candidate are
decided now, in rank order: each takes ``min(capacity, remaining)`` seats
while the course still has remaining demand (a running sum over that short
prefix). Everything earlier that could change their fate is decided by then,
so the decisions are the sequential loop's. Then live candidates that share
an accepted teacher-slot or room-slot die, and a fully seated course's
candidates die. The first live candidate overall is always free and first
of its course, so every round accepts at least one section.

Each round is two grouped minima over the live set, joins against per-round
tables and a window over the free prefix only (bounded by the number of
room-slots). A round writes its accepted sections; the live set is written anew
every few rounds and is the last one less what was accepted since, so lineage
never grows and a lost executor only repeats a round.

The first N accepted by rank are exactly the sequential loop's first N. Once
N are accepted, live candidates ranked after the N-th accepted one can no
longer enter the first N and are pruned.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semestra.session import drop_written, ensure_checkpoint_dir, materialize

log = logging.getLogger(__name__)


def score_order(score_col: str) -> F.Column:
    """Score descending as a number, smaller first; null and NaN scores last."""
    last = F.lit(float("inf"))
    return F.coalesce(F.nanvl(-F.col(score_col).cast("double"), last), last)


def rank_key(score_col: str, key_cols: Sequence[str]) -> F.Column:
    """Strict total order (D13): score descending, null scores last, then a hash of the keys
    (spreads ties so rounds stay few), then the keys themselves."""
    return F.struct(score_order(score_col).alias("s"),
                    F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])).alias("h"),
                    *[F.col(c).alias(f"k{i}") for i, c in enumerate(key_cols)])


def _struct_literal(value, dtype: T.StructType) -> F.Column:
    return F.struct(*[F.lit(value[i]).cast(f.dataType).alias(f.name)
                      for i, f in enumerate(dtype.fields)])


REWRITE = 4  # rounds between two writes of the live set
# Fractions of the candidate ranks tried as prefixes when a cap is set. They
# decide only how much is looked at: results are those of the whole table.
PREFIX_FRACTIONS = [1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 0.05, 0.2, 0.5]


def greedy_select(candidates: DataFrame, course_cols: Sequence[str], teacher_col: str,
                  room_col: str, slot_col: str, rank_col: str, capacity_col: str,
                  demand_col: str, max_sections: int | None = 100,
                  max_rounds: int = 100_000, prefix_factor: int = 64) -> tuple[DataFrame, int]:
    """Run G1 on ``candidates`` (one row per course x teacher x room x slot,
    ``rank_col`` a comparable struct whose first field ``s`` is the primary
    key, smaller = earlier).

    With a cap N, the rounds first run on a rank prefix (all candidates with
    ``s`` at most a threshold, ties included) of roughly ``prefix_factor x N``
    rows: decisions inside a rank prefix depend only on candidates inside it,
    so they are the sequential loop's. If the prefix accepts at least N, its
    first N are the answer; otherwise the prefix widens (next quantile) and
    the rounds run again, up to the whole table. The thresholds come from one
    ``percentile_approx`` pass (mergeable sketches, nothing row-sized reaches
    the driver); an inexact quantile only changes the prefix size.

    Returns (accepted rows with ``seats``, ``round`` and ``_ord`` = 1..n in
    sequential order; number of rounds run).
    """
    spark = candidates.sparkSession
    ensure_checkpoint_dir(spark)
    course_cols = list(course_cols)
    rk = rank_col
    # The candidate pipeline runs once: written with the primary rank key as a
    # top-level column, so prefix filters skip Parquet row groups by min/max.
    scratch: list[str] = []
    candidates = materialize(candidates.withColumn("_s", F.col(rk)["s"]), "candidates", scratch)
    s_col = F.col("_s")
    thresholds: list[float | None] = [None]
    if max_sections is not None:
        stats = candidates.agg(F.count(F.lit(1)).alias("n"),
                               F.percentile_approx(s_col, PREFIX_FRACTIONS, 100_000).alias("q")).first()
        n = stats["n"] or 0
        want = prefix_factor * max_sections
        qs = [q for f, q in zip(PREFIX_FRACTIONS, stats["q"] or []) if f * n >= want]
        thresholds = sorted(set(qs)) + [None]

    courses = materialize(candidates.groupBy(*course_cols)
                          .agg(F.max(demand_col).cast("long").alias("_remaining")), "courses",
                          scratch)
    state = _State(courses, scratch)
    prev = None
    for t in thresholds:
        # Only the new slice of the prefix is written; decisions already made
        # on the earlier prefix stand (its state carries over).
        part = candidates
        if prev is not None:
            part = part.filter(s_col > F.lit(prev))
        if t is not None:
            part = part.filter(s_col <= F.lit(t))
        state.payload.append(part)
        _rounds(state, part, course_cols, teacher_col, room_col, slot_col, rk,
                capacity_col, max_sections, max_rounds)
        log.info("greedy prefix s<=%s: %d accepted after %d rounds", t, state.n_accepted,
                 state.rounds)
        if max_sections is not None and state.n_accepted >= max_sections:
            break
        prev = t

    out = finish(state, candidates.drop("_s"), rk, max_sections)
    drop_written(spark, scratch)
    return out, state.rounds


def finish(state: _State, candidates: DataFrame, rk: str, max_sections: int | None) -> DataFrame:
    """The accepted sections with all columns of ``candidates``, ``seats``,
    ``round`` and ``_ord``, written as a table of their own (at most N rows, or
    one per room-slot); the candidates and round states are scratch."""
    if not state.accepted:
        return materialize(candidates.limit(0).withColumn("seats", F.lit(0).cast("long"))
                           .withColumn("round", F.lit(0)).withColumn("_ord", F.lit(0)), "timetable")
    acc = _union(state.accepted)
    if max_sections is not None:
        acc = acc.orderBy(rk).limit(max_sections)
    loop_cols = set(acc.columns)
    written = _union(state.payload)
    payload = [c for c in candidates.columns if c not in loop_cols or c == rk]
    acc = acc.join(written.select(*payload), rk)
    # Bounded by the cap or the number of room-slots: one ordered window.
    return materialize(acc.withColumn("_ord", F.row_number().over(Window.orderBy(rk))), "timetable")


class _State:
    """Decisions so far: accepted sections (written tables), the demand per
    course, rounds run, and the written candidate slices."""

    def __init__(self, courses: DataFrame, scratch: list[str]):
        self.courses = courses
        self.scratch = scratch
        self.accepted: list[DataFrame] = []
        self.payload: list[DataFrame] = []
        self.n_accepted = 0
        self.rounds = 0

    def remaining(self, course_cols: Sequence[str]) -> DataFrame:
        """course_cols, _remaining: demand less the seats given so far."""
        if not self.accepted:
            return self.courses
        taken = _union(self.accepted).groupBy(*course_cols).agg(F.sum("seats").alias("_taken"))
        return self.courses.join(taken, on=list(course_cols), how="left").select(
            *course_cols, (F.col("_remaining") - F.coalesce(F.col("_taken"), F.lit(0))).alias("_remaining"))


def _rounds(state: _State, candidates: DataFrame, course_cols: list[str], teacher_col: str,
            room_col: str, slot_col: str, rk: str, capacity_col: str,
            max_sections: int | None, max_rounds: int) -> None:
    """The round loop on one candidate slice, continuing from ``state``."""
    rk_type = candidates.schema[rk].dataType
    ts_keys, rs_keys = [teacher_col, slot_col], [room_col, slot_col]
    # The loop carries only what decisions need; the rest joins back at the end.
    loop_cols = list(dict.fromkeys(course_cols + [teacher_col, room_col, slot_col,
                                                  capacity_col, rk]))
    live = candidates.select(*loop_cols).join(
        state.remaining(course_cols).filter(F.col("_remaining") > 0).select(*course_cols),
        on=course_cols, how="left_semi")
    if state.accepted:
        done = _union(state.accepted)
        live = (live.join(done.select(*ts_keys), on=ts_keys, how="left_anti")
                .join(done.select(*rs_keys), on=rs_keys, how="left_anti"))
        if max_sections is not None and state.n_accepted >= max_sections:
            live = live.filter(F.col(rk) < _struct_literal(_nth(done, rk, max_sections), rk_type))

    # Every round on a non-empty live set accepts at least one section (the
    # first live candidate overall), so an empty round means nothing is live.
    base, fresh = live, []  # ``live`` is ``base`` less what ``fresh`` decided
    while True:
        if state.rounds >= max_rounds:
            raise RuntimeError(f"the timetable isn't complete after {max_rounds} rounds")
        state.rounds += 1
        t0 = time.perf_counter()
        courses = state.remaining(course_cols)
        ts_min = live.groupBy(*ts_keys).agg(F.min(rk).alias("_m_ts"))
        rs_min = live.groupBy(*rs_keys).agg(F.min(rk).alias("_m_rs"))
        tagged = (live.join(ts_min, ts_keys).join(rs_min, rs_keys)
                  .withColumn("_free", (F.col(rk) == F.col("_m_ts")) & (F.col(rk) == F.col("_m_rs")))
                  .drop("_m_ts", "_m_rs"))
        stop = (tagged.filter(~F.col("_free")).groupBy(*course_cols)
                .agg(F.min(rk).alias("_stop")))
        prefix = (tagged.filter(F.col("_free"))
                  .join(stop, course_cols, "left")
                  .filter(F.col("_stop").isNull() | (F.col(rk) < F.col("_stop")))
                  .drop("_stop", "_free")
                  .join(courses, course_cols))
        by_course = Window.partitionBy(*course_cols).orderBy(rk) \
            .rowsBetween(Window.unboundedPreceding, -1)
        left_before = F.col("_remaining") - F.coalesce(
            F.sum(F.col(capacity_col).cast("long")).over(by_course), F.lit(0))
        winners = (prefix.withColumn("_left", left_before)
                   .filter(F.col("_left") > 0)
                   .withColumn("seats", F.least(F.col("_left"), F.col(capacity_col).cast("long")))
                   .withColumn("round", F.lit(state.rounds))
                   .drop("_left", "_remaining"))
        winners = materialize(winners, "winners", state.scratch)
        n_new = winners.count()
        if n_new == 0:
            state.rounds -= 1
            break
        state.n_accepted += n_new
        state.accepted.append(winners)
        fresh.append(winners)
        if len(state.accepted) >= 16:
            state.accepted = [materialize(_union(state.accepted), "accepted", state.scratch)]

        now = _union(fresh)
        served = state.remaining(course_cols).filter(F.col("_remaining") <= 0).select(*course_cols)
        live = (base.join(now.select(*ts_keys), on=ts_keys, how="left_anti")
                .join(now.select(*rs_keys), on=rs_keys, how="left_anti")
                .join(served, on=course_cols, how="left_anti"))
        if max_sections is not None and state.n_accepted >= max_sections:
            nth = _nth(_union(state.accepted), rk, max_sections)
            live = live.filter(F.col(rk) < _struct_literal(nth, rk_type))
        if len(fresh) >= REWRITE:
            base, fresh = materialize(live, "live", state.scratch), []
            live = base
        log.info("greedy round %d: accepted %d in %.2fs", state.rounds, state.n_accepted,
                 time.perf_counter() - t0)


def _nth(acc: DataFrame, rk: str, n: int):
    """Rank of the n-th accepted section (n is the cap, a small number)."""
    return acc.select(rk).orderBy(rk).limit(n).agg(F.max(rk)).first()[0]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
