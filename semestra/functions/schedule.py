"""Column -> Column functions on time slots, teacher blocks and the course
catalogue's naming rules (F12, F13, F21-F23, F26, A11, A14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slot day abbreviations and their day names.
DAY_NAMES = {"L": "LUNES", "Ma": "MARTES", "Mi": "MIERCOLES", "Ju": "JUEVES",
             "V": "VIERNES", "S": "SABADO"}

# The five time slots offered to new sections, with start hour.
DEFAULT_SLOTS = [
    ("L-Mi-V 07:00-09:00", 7),
    ("L-Mi-V 09:00-11:00", 9),
    ("Ma-Ju 11:00-13:00", 11),
    ("Ma-Ju 15:00-17:00", 15),
    ("L-Mi-V 13:00-15:00", 13),
]

# Keyword rules for a course's department (checked in order:
# basic-science keywords, then the career, then administration keywords).
BASIC_SCIENCE_WORDS = ["CÁLCULO", "ÁLGEBRA", "ECUACIONES", "FÍSICA", "QUÍMICA",
                       "PROBABILIDAD", "MÉTODOS", "MATEMÁTICAS"]
ADMIN_WORDS = ["ADMINISTRACIÓN", "CONTABILIDAD", "ECONOMÍA", "MERCADOTECNIA", "CULTURA"]
CAREER_DEPARTMENT = {"ISC": "Sistemas", "IND": "Industrial"}
# Courses needing a lab, and the room names that are labs.
LAB_COURSE_WORDS = ["LAB", "TALLER", "DIBUJO"]
LAB_ROOM_PATTERN = "LAB|CC"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _day_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in DAY_NAMES.items() for x in kv])


def slot_days(slot) -> Column:
    """"L-Mi-V 07:00-09:00" -> [LUNES, MIERCOLES, VIERNES]; unknown
    abbreviations pass through."""
    abbrevs = F.split(F.get(F.split(_c(slot), " "), 0), "-")
    m = _day_map()
    return F.transform(abbrevs, lambda d: F.coalesce(F.element_at(m, d), d))


def slot_bounds(slot) -> tuple[Column, Column]:
    """Start and end hour of "... HH:MM-HH:MM"."""
    hours = F.split(F.get(F.split(_c(slot), " "), 1), "-")
    ini = F.get(F.split(F.get(hours, 0), ":"), 0).try_cast("int")
    fin = F.get(F.split(F.get(hours, 1), ":"), 0).try_cast("int")
    return ini, fin


def slot_hours(slot) -> Column:
    """the class hours start..end-1 ([] when the range is empty)."""
    ini, fin = slot_bounds(slot)
    return (F.when(fin > ini, F.sequence(ini, fin - 1))
            .otherwise(F.array().cast("array<int>")))


def block_map_ints(blocks) -> Column:
    """map<day, array<hour text>> -> map<day, array<int>>; a day with any
    hour that does not parse is dropped."""
    as_ints = F.transform_values(
        _c(blocks),
        lambda k, v: F.when(
            F.forall(v, lambda h: h.cast("string").try_cast("int").isNotNull()),
            F.transform(v, lambda h: h.cast("string").try_cast("int"))))
    return F.map_filter(as_ints, lambda k, v: v.isNotNull())


def blocks_text(blocks, sort_days: bool = True) -> Column:
    """A11: "DAY: h, h | DAY: h" for a block map (days in name order unless
    ``sort_days`` is off, then in map order)."""
    entries = F.map_entries(_c(blocks))
    if sort_days:
        entries = F.array_sort(entries)
    parts = F.transform(
        entries,
        lambda e: F.concat(e["key"], F.lit(": "),
                           F.array_join(F.transform(e["value"], lambda h: h.cast("string")), ", ")))
    return F.array_join(parts, " | ")


def hours_blocked_per_day(blocks) -> Column:
    """map<day, number of blocked hours>."""
    return F.transform_values(_c(blocks), lambda k, v: F.size(v))


def total_blocked_hours(blocks) -> Column:
    """Sum of A14 over the days of a block map."""
    return F.aggregate(F.map_values(hours_blocked_per_day(blocks)), F.lit(0),
                       lambda acc, x: acc + x)


def _contains_any(col: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(col, F.lit(w))
    return cond


def department_of(course, career) -> Column:
    """department that teaches a course."""
    name, car = _c(course), _c(career)
    dep = F.when(_contains_any(name, BASIC_SCIENCE_WORDS), "Ciencias Basicas")
    for k, v in CAREER_DEPARTMENT.items():
        dep = dep.when(car == k, v)
    return (dep.when(_contains_any(name, ADMIN_WORDS), "Administracion")
            .otherwise("Desarrollo Humano"))


def needs_lab(course) -> Column:
    """F23 (course side)."""
    return _contains_any(_c(course), LAB_COURSE_WORDS)


def is_lab_room(room_name) -> Column:
    """F23 (room side)."""
    return _c(room_name).rlike(LAB_ROOM_PATTERN)


def shared_course_id(course, career, n_careers) -> Column:
    """a course name offered by two careers gets "CB-name", otherwise
    "career-name". ``n_careers`` is the count of distinct careers of the name
    (a grouped count, see ``operators.aggregates.shared_course_ids``)."""
    return F.when(_c(n_careers) > 1, F.concat(F.lit("CB-"), _c(course))) \
        .otherwise(F.concat(_c(career), F.lit("-"), _c(course)))
