"""Line-level expressions: continuation lines and quick timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a continuation line begins.
CONTINUATION = (" ", "\t", "at ", "Caused by:", "Caused by ", "Traceback ", 'File "', "... ", "goroutine ", "}", "]")
EARLIEST_S, LATEST_S = 946684800, 4102444800


def is_continuation(line: Column) -> Column:
    test = F.lit(False)
    for start in CONTINUATION:
        test = test | F.startswith(line, F.lit(start))
    frame = F.startswith(line, F.lit("from ")) & (F.contains(line, F.lit(".rb:")) | F.contains(line, F.lit(".py:")))
    return F.coalesce(test | frame, F.lit(False))


def iso_nanos(text: Column) -> Column:
    """ISO-8601 at the start: nanoseconds since the epoch, whatever zone follows; null if out of range."""
    shaped = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}")
    seconds = F.unix_seconds(F.concat(F.left(text, F.lit(19)), F.lit("Z")).try_cast("timestamp"))
    # What the calendar does not have (a day beyond its month's end, second 60) rolls over.
    seconds = F.coalesce(seconds, _rolled_seconds(text))
    digits = F.when(
        F.substr(text, F.lit(20), F.lit(1)) == ".", F.regexp_extract(F.substr(text, F.lit(21), F.lit(9)), "^[0-9]+", 0)
    )
    fraction = F.coalesce(F.rpad(digits, 9, "0").try_cast("bigint"), F.lit(0))
    return F.when(shaped, seconds * 1_000_000_000 + fraction)


def _rolled_seconds(text: Column) -> Column:
    part = lambda a, n: F.substr(text, F.lit(a), F.lit(n)).try_cast("int")
    year, month, day = part(1, 4), part(6, 2), part(9, 2)
    hour, minute, second = part(12, 2), part(15, 2), part(18, 2)
    sound = month.between(1, 12) & day.between(1, 31) & (hour <= 23) & (minute <= 59) & (second <= 60)
    first = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-01"))
    days = F.unix_date(first.try_cast("date")) + day - 1
    return F.when(sound, days.cast("bigint") * 86400 + hour * 3600 + minute * 60 + second)


def json_epoch_nanos(text: Column) -> Column:
    """Epoch milliseconds behind a "ts" or "timestamp" key that begins within 48 characters."""
    head = F.substr(text, F.lit(1), F.lit(48))
    short, long = F.instr(head, '"ts":'), F.instr(head, '"timestamp":')
    after = F.when(short > 0, F.substr(text, short + 5)).when(long > 0, F.substr(text, long + 12))
    value = F.regexp_extract(after, r"^ *([0-9]{10,16})(?![0-9])", 1).try_cast("bigint")
    return F.when(value.between(EARLIEST_S * 1000, LATEST_S * 1000), value * 1_000_000)


def epoch_nanos(text: Column) -> Column:
    value = F.regexp_extract(text, r"^([1-9][0-9]{9})(?=$|[ \t.])", 1).try_cast("bigint")
    return F.when(value.between(EARLIEST_S, LATEST_S), value * 1_000_000_000)


def quick_timestamp(line: Column) -> Column:
    """The first that matches: ISO-8601, epoch milliseconds in JSON, epoch seconds. Nanoseconds or null."""
    return F.coalesce(iso_nanos(line), json_epoch_nanos(line), epoch_nanos(line))
