"""Display filters: a predicate tree compiled to one Column, and the intent grammar.

Predicates are two-valued: a missing value fails a test, and so passes its negation.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embermill.functions.fields import field_float, field_get
from embermill.functions.severity import LEVELS

# Words that an intent query passes over, and words that name severities or imply errors.
FILLER = frozenset(
    "the a an is are was were in on at to for of with and or but not related about why what how when where show me "
    "find get all any some that this those requests logs events messages".split()
)
SEVERITY_WORDS = {
    "errors": "error", "error": "error", "warnings": "warn", "warning": "warn", "fatal": "fatal", "critical": "fatal",
    "5xx": "error", "4xx": "warn",
}
ERROR_WORDS = ("fail", "crash", "down", "broken", "bug")
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


@dataclass(frozen=True)
class Clause:
    """One test on an event. ``kind`` names it, ``args`` are its operands."""

    kind: str
    args: tuple
    negated: bool = False

    def __invert__(self) -> Clause:
        return Clause(self.kind, self.args, not self.negated)

    def column(self) -> Column:
        test = F.coalesce(_TESTS[self.kind](*self.args), F.lit(False))
        return ~test if self.negated else test


@dataclass(frozen=True)
class Predicate:
    clauses: tuple[Clause, ...] = ()
    any_of: bool = False

    def column(self) -> Column:
        if not self.clauses:
            return F.lit(True)
        each = [c.column() for c in self.clauses]
        return functools.reduce((lambda a, b: a | b) if self.any_of else (lambda a, b: a & b), each)

    def __add__(self, other: Predicate) -> Predicate:
        return Predicate(self.clauses + other.clauses, self.any_of)


def _number(level: str) -> int:
    return LEVELS.index(level) if level in LEVELS else 0


def _field_eq(key: str, text: str) -> Column:
    v = field_get(F.col("fields"), key)
    as_int = int(text) if re.fullmatch(r"[+-]?\d{1,18}", text) else None
    whole = v["i"] == F.lit(as_int) if as_int is not None else F.lit(False)
    return F.when(v["kind"] == "string", v["s"] == text).when(v["kind"] == "int", whole).otherwise(F.lit(False))


_TESTS = {
    "severity_gte": lambda level: F.col("sev_num") >= _number(level),
    "severity_eq": lambda level: F.col("severity") == level,
    "service_eq": lambda x: F.col("service") == x[:64],
    "trace_id_eq": lambda x: F.col("trace_id") == x[:64],
    "message_contains": lambda x: F.contains("message", F.lit(x[:256])),
    "field_eq": _field_eq,
    "field_gt": lambda k, t: field_float(F.col("fields"), k) > t,
    "field_lt": lambda k, t: field_float(F.col("fields"), k) < t,
    "template_hash_eq": lambda h: F.col("template_hash") == F.lit(str(h)).cast("decimal(20,0)"),
}


def clause(kind: str, *args) -> Clause:
    if kind not in _TESTS:
        raise ValueError(f"no test named {kind}")
    return Clause(kind, args)


def all_of(*clauses: Clause) -> Predicate:
    return Predicate(clauses)


def any_of(*clauses: Clause) -> Predicate:
    return Predicate(clauses, True)


def parse_duration(text: str) -> int | None:
    """Seconds of a duration such as 15m; None if it is none."""
    found = re.fullmatch(r"(\d+)([smhd])", text)
    return int(found[1]) * UNITS[found[2]] if found else None


def parse_intent(query: str) -> Predicate:
    """Words, left to right, as clauses that must all hold."""
    words = re.split(r"[ \t]+", query.strip(" \t"))
    out: list[Clause] = []
    at = 0
    while at < len(words):
        word = words[at]
        low = word.lower()
        at += 1
        if not word or low in FILLER:
            continue
        if low in SEVERITY_WORDS:
            out.append(clause("severity_gte", SEVERITY_WORDS[low]))
        elif low == "from":
            if at < len(words) and words[at].lower() not in FILLER:
                out.append(clause("service_eq", words[at]))
            at += 1
        elif word.startswith("service:"):
            out.append(clause("service_eq", word.removeprefix("service:")))
        elif low in ("over", "above"):
            at += 1
        else:
            out.append(clause("message_contains", word[:-1] if len(word) > 3 and word.endswith("s") else word))
    severe = any(c.kind in ("severity_gte", "severity_eq") for c in out)
    if not severe and any(w in query[:256].lower() for w in ERROR_WORDS):
        out.append(clause("severity_gte", "error"))
    return Predicate(tuple(out))


def last(now: Column, seconds: int) -> Column:
    return F.unix_micros("ts") >= F.unix_micros(now) - F.lit(seconds * 1_000_000)


def display(events: DataFrame, predicate: Predicate = Predicate(), min_severity: str | None = None, since: Column | None = None) -> DataFrame:
    """The events to show. Only this branch is filtered: groups, rates and traces see every event."""
    test = predicate.column()
    if since is not None:
        test = since & test
    if min_severity is not None:
        test = clause("severity_gte", min_severity).column() & test
    return events.where(test)
