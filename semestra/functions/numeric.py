"""Column -> Column arithmetic and rule functions (P6, F6-F11, F14-F20, F24,
F28, F29)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values from the reference's rules.
PASS_GRADE = 70.0          # grade >= 70 passes
SCORE_FACTORS = 5.0        # TOO = (UC + TA + DPF + Q/100 + AS - TC) / 5
DEMAND_CAP = 100.0         # serving-side demand factor: min(1, demand / 100)
ATTENDANCE_POINTS = 50.0   # attendance factor (+-0.5) is worth 50 score points
MIN_OPEN_SEATS = 15        # sections below 15 seats do not open
SMALL_GROUP_SEMESTER = 5   # semester > 5 -> groups of 25, else 35
SMALL_GROUP, LARGE_GROUP = 25, 35


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_bool(flag) -> Column:
    """Boolean-as-text ('True', 'false', True) to boolean; junk -> null."""
    return _c(flag).cast("string").try_cast("boolean")


def not_dropped(flag) -> Column:
    """Keep only rows whose desertion flag is false (text or boolean).
    'True' and null are dropped."""
    return F.coalesce(~as_bool(flag), F.lit(False))


def flag_to_int(flag) -> Column:
    """1 when the flag reads true, else 0."""
    return F.when(F.coalesce(as_bool(flag), F.lit(False)), 1).otherwise(0)


def active_flag(flag) -> Column:
    """case-insensitive 'true'."""
    return F.lower(_c(flag).cast("string")) == F.lit("true")


def safe_ratio(n, d) -> Column:
    """n/d when d > 0, else 0.0."""
    return F.when(_c(d) > 0, _c(n) / _c(d)).otherwise(F.lit(0.0))


def normalize_by_max(value, max_value) -> Column:
    """F8 with A6's guard: value / max when value > 0; a max <= 0 or null is 1."""
    m = F.when(_c(max_value) > 0, _c(max_value)).otherwise(F.lit(1))
    return F.when(_c(value) > 0, _c(value) / m).otherwise(F.lit(0.0))


def composite_score(uc, ta, dpf, quality, attendance, conflict) -> Column:
    """the section score TOO."""
    return (_c(uc) + _c(ta) + _c(dpf) + _c(quality) / F.lit(100.0)
            + _c(attendance) - _c(conflict)) / F.lit(SCORE_FACTORS)


def cap_ratio(demand, cap: float = DEMAND_CAP) -> Column:
    """demand > cap -> 1.0 else demand / cap."""
    return F.when(_c(demand) > cap, F.lit(1.0)).otherwise(_c(demand) / F.lit(float(cap)))


def round_half_up(col, digits: int) -> Column:
    """F11 for Spark-side rounding (HALF_UP on the decimal text of the double)."""
    return F.round(_c(col), digits)


def round_half_even(col, digits: int) -> Column:
    """F11 where the reference rounded in Python (banker's rounding)."""
    return F.bround(_c(col), digits)


def clip(col, lo: float = 0.0, hi: float = 100.0) -> Column:
    """F14."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(col)))


def attendance_adjustment(total, present, absent) -> Column:
    """more than half present -> +0.5; absences above presences -> -0.5."""
    t, p, a = _c(total), _c(present), _c(absent)
    return (F.when(F.coalesce(t, F.lit(0)) == 0, F.lit(0.0))
            .when(p / t > 0.5, F.lit(0.5))
            .when(a > p, F.lit(-0.5))
            .otherwise(F.lit(0.0)))


def occupancy_factor(seats, capacity) -> Column:
    """F16: seats/capacity below one half multiplies the score by that ratio."""
    pct = _c(seats) / _c(capacity)
    return F.when(pct < 0.5, pct).otherwise(F.lit(1.0))


def percent_if_fraction(col) -> Column:
    """a rate <= 1 is shown as a percentage with one decimal."""
    v = _c(col).cast("double")
    return F.when(v <= 1, F.round(v * 100, 1)).otherwise(v)


def score_tier(col) -> Column:
    """>= 90 success, >= 80 warning, else danger."""
    return (F.when(_c(col) >= 90, "success").when(_c(col) >= 80, "warning")
            .otherwise("danger"))


def teacher_tier(col) -> Column:
    """F18 (teacher table): average >= 80 is 'good'."""
    return F.when(_c(col) >= 80, "good").otherwise("low")


def seats_text(seats, capacity) -> Column:
    """"n/cap"."""
    return F.concat_ws("/", _c(seats).cast("string"), _c(capacity).cast("string"))


def split_seats(text) -> Column:
    """F19 inverse: "n/cap" -> struct(seats int, capacity int)."""
    parts = F.split(_c(text), "/")
    return F.struct(F.get(parts, 0).try_cast("int").alias("seats"),
                    F.get(parts, 1).try_cast("int").alias("capacity"))


def sections_needed(demand, semester) -> Column:
    """ceil(demand / group size), group size 25 above semester 5 else 35."""
    size = F.when(_c(semester) > SMALL_GROUP_SEMESTER, SMALL_GROUP).otherwise(LARGE_GROUP)
    return F.ceil(_c(demand) / size)


def effective_capacity(group_size, room_capacity) -> Column:
    """F28."""
    return F.least(_c(group_size), _c(room_capacity))


def load_class(course_semester, current_semester) -> Column:
    """below the current semester is backlog, equal is regular."""
    return (F.when(_c(course_semester) < _c(current_semester), "backlog")
            .when(_c(course_semester) == _c(current_semester), "regular"))
