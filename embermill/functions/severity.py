"""Severity: six ordered levels and an unknown one that counts as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")
LABELS = {**{name: name.upper() for name in LEVELS}, "unknown": "???"}

# Spellings of each level. A spelling with * matches as a prefix.
SPELLINGS = {
    "trace": ("trace*",),
    "debug": ("debug*", "dbg"),
    "info": ("info*", "inf", "i"),
    "warn": ("warn*", "wrn", "w"),
    "error": ("error*", "err", "e"),
    "fatal": ("fatal*", "ftl", "crit*"),
}


def parse_severity(word: Column) -> Column:
    low = F.lower(word)
    out = F.lit("unknown")
    for level in reversed(LEVELS):
        prefixes = [s[:-1] for s in SPELLINGS[level] if s.endswith("*")]
        exact = [s for s in SPELLINGS[level] if not s.endswith("*")]
        test = low.rlike("^(?:" + "|".join(prefixes) + ")")
        out = F.when(test | low.isin(*exact) if exact else test, F.lit(level)).otherwise(out)
    return out


def severity_number(level: Column) -> Column:
    """0 (trace and unknown) to 5, as a tinyint."""
    out = F.lit(0)
    for i, name in enumerate(LEVELS):
        out = F.when(level == name, F.lit(i)).otherwise(out)
    return out.cast("tinyint")


def severity_label(level: Column) -> Column:
    out = F.lit(LABELS["unknown"])
    for name in LEVELS:
        out = F.when(level == name, F.lit(LABELS[name])).otherwise(out)
    return out


def severity_name(number: Column) -> Column:
    """The level of a largest number; 0 is unknown, as a group of trace events has it."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in ("unknown", *LEVELS[1:])]), number.cast("int")), F.lit("unknown"))
