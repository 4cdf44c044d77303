"""Candidate sections, teacher blocks, the greedy timetable and its KPIs
(Q12, Q15, Q16, Q17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semestra.functions.numeric import (ATTENDANCE_POINTS, MIN_OPEN_SEATS, active_flag, clip,
                                        occupancy_factor, round_half_even, seats_text)
from semestra.functions.numeric import sections_needed
from semestra.functions.schedule import (DEFAULT_SLOTS, block_map_ints, blocks_text,
                                         department_of, is_lab_room, needs_lab,
                                         total_blocked_hours)
from semestra.operators.greedy import greedy_select, rank_key
from semestra.operators.joins import drop_blocked, expand_slot
from semestra.operators.rank_join import rank_join_select

DEFAULT_ROOM_CAPACITY = 30  # fixed value: capacity when a room has none
MAX_SECTIONS: int | None = None  # a planner may cap the timetable's length


def slot_array(slots: Sequence[tuple[str, int]] = DEFAULT_SLOTS) -> F.Column:
    """The offered slots as a literal array of struct(str, inicio)."""
    return F.array(*[F.struct(F.lit(s).alias("str"), F.lit(h).alias("inicio"))
                     for s, h in slots])


def department_teacher_pairs(courses: DataFrame, teachers: DataFrame) -> DataFrame:
    """Teachers that may teach a course: those of the course's department
    (F22), as an equi-join on the department; where a department has none, all
    teachers (they are listed under it as well)."""
    c = courses.select("materia_nombre", "carrera_materia").distinct() \
        .withColumn("departamento", department_of("materia_nombre", "carrera_materia"))
    t = teachers.select("profesor_id", "nombre_profesor", "departamento")
    # Departments are a handful of fixed names.
    bare = [r.departamento for r in c.select("departamento").distinct().join(t, "departamento", "left_anti").collect()]
    if bare:
        every = t.drop("departamento").withColumn("departamento", F.explode(F.array(*map(F.lit, bare))))
        t = t.unionByName(every)
    return c.join(t, "departamento").drop("departamento")


def lab_pools(courses: DataFrame, rooms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """courses needing a lab meet in LAB/CC rooms, the rest elsewhere;
    expressed as a shared ``room_pool`` key for an equi-join."""
    return (courses.withColumn("room_pool", needs_lab("materia_nombre").cast("int")),
            rooms.withColumn("room_pool", is_lab_room("nombre_salon").cast("int")))


def candidate_sections(courses: DataFrame, teacher_pairs: DataFrame, rooms: DataFrame,
                       slots: Sequence[tuple[str, int]] = DEFAULT_SLOTS) -> DataFrame:
    """Q12 (J6): course x qualified teacher x room of its pool x slot.

    The teacher and room sides are equi-joins on the course and on the room
    pool (never a cross join); the slots are a literal array exploded per row
    (a bounded generator). Columns: materia_nombre, semestre_materia,
    carrera_materia, demanda_real, profesor_id, nombre_profesor (plus any
    other teacher-pair column, e.g. a score), salon_id, capacidad_base, str,
    inicio.

    The room join and the slot explode multiply rows by rooms x slots after
    the last shuffle, so the (course, teacher) pairs are spread over the
    session's shuffle partitions first; otherwise adaptive coalescing, which
    only sees the small pre-explode size, would run the expansion in one task.
    """
    keys = ["materia_nombre", "carrera_materia"]
    c = courses.select(*keys, "semestre_materia", "demanda_real", "room_pool")
    r = rooms.select("salon_id", "capacidad_base", "room_pool")
    n_parts = int(courses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = c.join(teacher_pairs, keys)
    extra = [x for x in pairs.columns
             if x not in set(keys) | {"semestre_materia", "demanda_real", "room_pool"}]
    return (pairs.repartition(n_parts, *keys, "profesor_id")
            .join(r, "room_pool")
            .withColumn("_slot", F.explode(slot_array(slots)))
            .select(*keys, "semestre_materia", "demanda_real", *extra, "salon_id",
                    "capacidad_base",
                    F.col("_slot.str").alias("str"), F.col("_slot.inicio").alias("inicio")))


def restriction_blocks(restrictions: DataFrame) -> DataFrame:
    """Q15: active teacher restrictions (F20) -> (profesor_id, dia, hora) rows.
    Days whose hours do not all parse are dropped (F21); teachers left with no
    day contribute nothing."""
    act = restrictions.filter(active_flag("activo"))
    clean = act.select("profesor_id", block_map_ints("bloqueos").alias("_b"))
    return (clean.select("profesor_id", F.explode("_b").alias("dia", "_h"))
            .select("profesor_id", "dia", F.explode("_h").alias("hora"))
            .distinct())


def restriction_summary(restrictions: DataFrame) -> DataFrame:
    """Q15 as the control panel lists it: per active teacher with at least
    one clean day, the block text (A11) and the number of blocked hours (A14)."""
    clean = (restrictions.filter(active_flag("activo"))
             .select("profesor_id", block_map_ints("bloqueos").alias("_b"))
             .filter(F.size("_b") > 0))
    return clean.select("profesor_id", blocks_text("_b").alias("bloqueos_texto"),
                        total_blocked_hours("_b").alias("total_horas"))


def sections_plan(demand: DataFrame) -> DataFrame:
    """sections a course needs for its demand (groups of 25 above the
    fifth semester, else 35)."""
    return demand.withColumn("grupos_necesarios",
                             sections_needed("demanda_real", "semestre_materia"))


def greedy_timetable(scored: DataFrame, blocks: DataFrame | None = None,
                     attendance: DataFrame | None = None,
                     max_sections: int | None = MAX_SECTIONS,
                     rank_by_adjusted: bool = False) -> tuple[DataFrame, int]:
    """Q16 (G1): the timetable.

    ``scored`` holds candidate sections with ``score_predicho``. Blocked
    teacher hours are removed first (J10). The attendance factor (F15, per
    teacher) moves the reported score by +-50 points, clipped to 0..100 (F14);
    by default it does not change the selection order (D12). Selection is the
    sequential greedy rule computed in rounds (see operators.greedy). Each
    accepted section seats min(remaining demand, room capacity); the reported
    score is multiplied by the occupancy when under half full (F16).

    Returns (timetable, rounds).
    """
    c = scored
    if blocks is not None:
        c = drop_blocked(c, blocks, "profesor_id", "str")
    c = _with_factors(c, attendance).withColumn("capacidad", _capacity())
    order_col = "score_ajustado" if rank_by_adjusted else "score_predicho"
    c = c.withColumn("_rk", rank_key(order_col, [*COURSE, "profesor_id", "salon_id", "str"]))
    acc, rounds = greedy_select(c, COURSE, "profesor_id", "salon_id", "str", "_rk", "capacidad", "demanda_real",
                                max_sections=max_sections)
    return _published(acc), rounds


COURSE = ["materia_nombre", "carrera_materia"]


def _capacity() -> F.Column:
    return F.coalesce(F.col("capacidad_base").cast("int"), F.lit(DEFAULT_ROOM_CAPACITY))


def _with_factors(scored: DataFrame, attendance: DataFrame | None) -> DataFrame:
    """The teacher's attendance factor and the score it moves."""
    if attendance is not None:
        scored = scored.join(attendance.select("profesor_id", "factor_asistencia"), "profesor_id", "left")
    else:
        scored = scored.withColumn("factor_asistencia", F.lit(None).cast("double"))
    factor = F.coalesce("factor_asistencia", F.lit(0.0))
    return (scored.withColumn("factor_asistencia", factor)
            .withColumn("score_ajustado", clip(F.col("score_predicho") + F.col("factor_asistencia") * ATTENDANCE_POINTS)))


def blocked_slots(blocks: DataFrame, slots: Sequence[tuple[str, int]] = DEFAULT_SLOTS) -> DataFrame:
    """(profesor_id, str): offered slots with a blocked hour of the teacher
    (J10), by a join with the hours of the slots, a handful of literal rows."""
    offered = blocks.sparkSession.range(1).select(F.explode(slot_array(slots)["str"]).alias("str"))
    return blocks.join(expand_slot(offered), ["dia", "hora"]).select("profesor_id", "str").distinct()


def room_slots(rooms: DataFrame, slots: Sequence[tuple[str, int]] = DEFAULT_SLOTS) -> DataFrame:
    """Rooms at every offered slot, with their capacity."""
    slot = F.explode(slot_array(slots)).alias("_slot")
    return rooms.select("*", slot).select(
        *[c for c in rooms.columns if c not in ("str", "inicio")], F.col("_slot.str").alias("str"),
        F.col("_slot.inicio").alias("inicio")).withColumn("capacidad", _capacity())


def rank_join_timetable(offers: DataFrame, rooms: DataFrame, on: Sequence[str] = ("room_pool",),
                        blocks: DataFrame | None = None, attendance: DataFrame | None = None,
                        max_sections: int | None = MAX_SECTIONS, rank_by_adjusted: bool = False,
                        slots: Sequence[tuple[str, int]] = DEFAULT_SLOTS) -> tuple[DataFrame, int]:
    """Q12 and Q16 in one: the timetable of ``greedy_timetable`` without the
    candidates ever written out.

    ``offers``: a course with its demand, a teacher, the ``score_predicho`` of
    the two and the columns ``on`` shared with ``rooms`` at a slot (the room
    pool; with a score that depends on the hour or the capacity, also
    ``inicio`` and ``capacidad_base``). Offers are expanded in rank order, at
    the places still open (operators.rank_join).
    """
    scored = _with_factors(offers, attendance)
    busy = blocked_slots(blocks, slots) if blocks is not None else None
    acc, rounds = rank_join_select(
        scored, room_slots(rooms, slots), on, COURSE, "profesor_id", "salon_id", "str",
        "score_ajustado" if rank_by_adjusted else "score_predicho", "capacidad", "demanda_real", busy, max_sections)
    return _published(acc), rounds


def _published(acc: DataFrame) -> DataFrame:
    """Accepted sections as the timetable lists them."""
    return acc.select(
        F.col("_ord").alias("id"),
        F.col("materia_nombre").alias("materia"),
        F.col("semestre_materia").cast("int").alias("semestre"),
        F.concat(F.lit("G"), (F.col("_ord") + 100).cast("string")).alias("grupo"),
        F.col("nombre_profesor").alias("profesor"),
        "profesor_id",
        F.col("carrera_materia").alias("carrera"),
        F.col("str").alias("horario"),
        F.col("salon_id").alias("salon"),
        round_half_even(F.col("score_ajustado") * occupancy_factor("seats", "capacidad"), 1)
        .alias("score"),
        seats_text("seats", "capacidad").alias("demanda"),
        F.col("seats").cast("int").alias("inscritos"),
        F.col("capacidad").cast("int").alias("capacidad"),
        (F.col("seats") >= MIN_OPEN_SEATS).alias("opens"),
        "factor_asistencia",
        "round",
    )


def schedule_kpis(timetable: DataFrame) -> DataFrame:
    """Q17 (A12): one row: mean reported score, seats placed, capacity of the
    sections that open (>= 15 seats, D14) and seats placed over that capacity
    in percent (D15: may exceed 100)."""
    opens = F.col("inscritos") >= MIN_OPEN_SEATS
    agg = timetable.agg(
        F.count(F.lit(1)).alias("num_grupos"),
        F.sum(F.when(opens, 1).otherwise(0)).cast("long").alias("num_grupos_abren"),
        F.avg("score").alias("_avg"),
        F.sum("inscritos").cast("long").alias("cupos_asignados"),
        F.sum(F.when(opens, F.col("capacidad")).otherwise(0)).cast("long").alias("capacidad_abierta"))
    return agg.select(
        "num_grupos", F.coalesce("num_grupos_abren", F.lit(0).cast("long")).alias("num_grupos_abren"),
        round_half_even(F.coalesce("_avg", F.lit(0.0)), 1).alias("avgScore"),
        F.coalesce("cupos_asignados", F.lit(0)).alias("cupos_asignados"),
        F.coalesce("capacidad_abierta", F.lit(0)).alias("capacidad_abierta"),
        round_half_even(F.when(F.col("capacidad_abierta") > 0,
                               F.col("cupos_asignados") / F.col("capacidad_abierta") * 100)
                        .otherwise(F.lit(0.0)), 1).alias("demandaSatisfecha"))


def filter_suggestions(timetable: DataFrame, carrera: str = "all", semestre: str = "all",
                       text: str = "") -> DataFrame:
    """The suggestion list as the planner filters it: career and semester
    equal unless 'all'; the text, case-insensitive, inside the course or the
    teacher name (empty text keeps every row)."""
    cond = F.lit(True)
    if carrera != "all":
        cond = cond & (F.col("carrera") == F.lit(carrera))
    if semestre != "all":
        cond = cond & (F.col("semestre").cast("string") == F.lit(str(semestre)))
    if text:
        needle = F.lower(F.lit(text))
        cond = cond & (F.coalesce(F.contains(F.lower("materia"), needle), F.lit(False))
                       | F.coalesce(F.contains(F.lower("profesor"), needle), F.lit(False)))
    return timetable.filter(cond)
