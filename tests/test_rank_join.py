"""The rank join gives the timetable of the whole expansion, and expands little."""

import random

import pytest
from pyspark.sql import functions as F

from semestra.operators import rank_join
from semestra.operators.greedy import greedy_select, rank_key
from semestra.operators.rank_join import rank_join_select
from tests.test_greedy import KEYS, sequential

OFFER = "course string, teacher string, pool string, score double, demand int"
PLACE = "room string, slot string, pool string, capacity int"


def tables(spark, rng, n_courses=6, n_teachers=5, n_rooms=6, n_slots=3, scores=(1.0, 2.0, 3.0, None, float("nan"))):
    pools = {f"c{i}": f"p{i % 2}" for i in range(n_courses)}
    demand = {c: rng.choice([0, 10, 40, 90]) for c in pools}
    offers = [(c, f"t{t}", pools[c], rng.choice(scores), demand[c])
              for c in pools for t in range(n_teachers) if rng.random() < 0.7]
    places = [(f"r{r}", f"s{s}", f"p{r % 2}", 20 + 5 * (r % 3)) for r in range(n_rooms) for s in range(n_slots)]
    return spark.createDataFrame(offers, OFFER), spark.createDataFrame(places, PLACE)


def listed(acc):
    return [(r.course, r.teacher, r.room, r.slot, r.seats) for r in acc.orderBy("_ord").collect()]


@pytest.mark.parametrize("case", range(4))
def test_equals_the_sequential_walk_of_all_candidates(spark, case):
    rng = random.Random(case)
    offers, places = tables(spark, rng)
    busy = spark.createDataFrame([(f"t{rng.randrange(5)}", f"s{rng.randrange(3)}") for _ in range(4)] if case else [],
                                 "teacher string, slot string")
    cap, factor = [None, 4, None, 7][case], [1, 2, 16, 1][case]
    whole = (offers.join(places, "pool").join(busy, ["teacher", "slot"], "left_anti").withColumn("_rk", rank_key("score", KEYS)))
    want = sequential([r.asDict() for r in whole.orderBy("_rk").collect()], cap)
    acc, _ = rank_join_select(offers, places, ["pool"], ["course"], "teacher", "room", "slot", "score", "capacity", "demand",
                              busy, cap, factor)
    assert listed(acc) == want and want
    assert set(offers.columns + places.columns) <= set(acc.columns)


def test_one_score_for_all_is_taken_by_ranges_of_the_hash(spark, monkeypatch):
    rng = random.Random(9)
    offers, places = tables(spark, rng, n_courses=10, n_teachers=8, scores=(None,))
    slices = []
    inner = rank_join._bound

    def bound(weighed, done, goal):
        slices.append(inner(weighed, done, goal))
        return slices[-1]

    monkeypatch.setattr(rank_join, "_bound", bound)
    acc, _ = rank_join_select(offers, places, ["pool"], ["course"], "teacher", "room", "slot", "score", "capacity", "demand",
                              factor=1)
    whole = offers.join(places, "pool").withColumn("_rk", rank_key("score", KEYS))
    assert listed(acc) == sequential([r.asDict() for r in whole.orderBy("_rk").collect()], None)
    assert len(slices) > 2 and all(s is None or s[0] == float("inf") for s in slices) and slices[0][1] < 0.5


def test_scores_by_slot_and_capacity(spark):
    rng = random.Random(3)
    _, places = tables(spark, rng)
    offers = spark.createDataFrame(
        [(f"c{c}", f"t{t}", f"p{c % 2}", f"s{s}", k, float(rng.randint(1, 5)), 60)
         for c in range(5) for t in range(4) for s in range(3) for k in (20, 25, 30)],
        "course string, teacher string, pool string, slot string, capacity int, score double, demand int")
    on = ["pool", "slot", "capacity"]
    whole = offers.join(places, on).withColumn("_rk", rank_key("score", KEYS))
    acc, _ = rank_join_select(offers, places, on, ["course"], "teacher", "room", "slot", "score", "capacity", "demand", factor=2)
    assert listed(acc) == sequential([r.asDict() for r in whole.orderBy("_rk").collect()], None)


def test_written_rows_grow_with_places_not_offers(spark, monkeypatch):
    rng = random.Random(5)
    places = spark.createDataFrame([(f"r{r}", f"s{s}", "p", 30) for r in range(3) for s in range(3)], PLACE)
    rows = []
    inner = rank_join.materialize

    def counted(df, name="t", written=None):
        out = inner(df, name, written)
        if name == "slice":
            rows.append(out.count())
        return out

    monkeypatch.setattr(rank_join, "materialize", counted)
    offers = spark.createDataFrame([(f"c{i % 40}", f"t{i}", "p", rng.random(), 500) for i in range(4000)], OFFER)
    acc, _ = rank_join_select(offers, places, ["pool"], ["course"], "teacher", "room", "slot", "score", "capacity", "demand")
    assert acc.count() == 9 and sum(rows) < 1000  # of 36,000 candidates


def test_empty_tables(spark):
    offers, places = tables(spark, random.Random(1))
    for o, p in ((offers.limit(0), places), (offers, places.limit(0)), (offers.where("demand = 0"), places)):
        acc, rounds = rank_join_select(o, p, ["pool"], ["course"], "teacher", "room", "slot", "score", "capacity", "demand")
        assert acc.count() == 0 and rounds == 0 and "_ord" in acc.columns


def test_kpis_of_an_empty_timetable_are_zero(spark):
    from semestra.plans.timetable import rank_join_timetable, schedule_kpis
    offers = spark.createDataFrame([], "materia_nombre string, carrera_materia string, semestre_materia int, demanda_real long, "
                                       "room_pool int, profesor_id long, nombre_profesor string, score_predicho double")
    rooms = spark.createDataFrame([("R1", 20, 0)], "salon_id string, capacidad_base int, room_pool int")
    plan, _ = rank_join_timetable(offers, rooms)
    assert [tuple(r) for r in schedule_kpis(plan).collect()] == [(0, 0, 0.0, 0, 0, 0.0)]
