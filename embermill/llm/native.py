"""Column helpers that stay in the JVM: match positions by split and extract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that part words of plain text, as a regex class body.
SPACES = r"\x20\x09-\x0D"
PLAIN_WORD = rf"[^{SPACES}]+"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where expressions are interpreted."""
    return F.get(F.transform(F.array(value), use), 0)


#: Matches that are added up in one go; more are taken in blocks of so many.
BLOCK = 256


def positions(text: Column, pattern: Column | str, block: int = BLOCK) -> Column:
    """array<struct<start,end,hit>> of the leftmost non-overlapping matches, in code points.

    The text between matches (split) and the matches themselves
    (regexp_extract_all) come from the same left-to-right search, so their
    lengths add up to the positions.  Appending to an array copies it, so sums run
    inside blocks and the blocks are then moved to their places.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["gap"])
        end = at + F.length(x["hit"])
        span = F.struct(at.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    def summed(pairs: Column) -> Column:
        return F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step)

    def moved(part: Column, by: Column) -> Column:
        return F.transform(
            part["out"],
            lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["hit"].alias("hit")),
        )

    def joined(parts: Column) -> Column:
        ends = F.aggregate(
            parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["pos"]))
        )
        return F.flatten(F.zip_with(parts, F.slice(ends, 1, F.size(parts)), moved))

    def placed(pairs: Column) -> Column:
        blocks = F.sequence(F.lit(1), F.size(pairs), F.lit(block))
        many = F.transform(blocks, lambda b: summed(F.slice(pairs, b, F.lit(block))))
        return F.when(F.size(pairs) <= block, summed(pairs)["out"]).otherwise(let(many, joined))

    def found(hits: Column) -> Column:
        gaps = F.slice(F.split(text, regex, -1), 1, F.size(hits))
        pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.when(F.size(hits) == 0, empty).otherwise(let(pairs, placed))

    return let(F.regexp_extract_all(text, regex, F.lit(0)), found)
