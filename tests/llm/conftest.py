import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls, empty, odd and long texts."""
    r = random.Random(seed)
    base, passage = prose(r, 120), prose(r, 55)
    words = base.split()
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = prose(r, r.randint(1, 200))
        elif kind == 1:
            w = list(words)
            w[r.randrange(len(w))] = "edit" + str(i)
            text = " ".join(w)
        elif kind == 2:
            text = prose(r, 40) + "\n" + passage + "\t" + prose(r, 40)
        elif kind == 3:
            text = base
        elif kind == 4:
            text = r.choice(["", " ", "a", "b b", "x y z", "\n\t "])
        else:
            text = base.upper() if r.random() < 0.5 else prose(r, 3) + "  " + base[: r.randint(1, 500)]
        rows.append((i * 3 % n + (i // n), text, "en", r.choice(["s1", "s2", None, "s1"]), len(text)))
    rows += [(None, base, None, None, None), (None, None, None, "s2", 0), (n + 1, None, "en", "s1", None), rows[1], rows[3], rows[3]]
    rows.append((n + 2, "w" * 50_000 + " " + "9 " * 20_000, "en", "s3", 1))
    rows.append((n + 3, "so so " * 30_000, "en", "s3", 1))
    return rows


#: Names that operators use inside or give out: an input's own columns of these names must do no harm.
CLASH = ("size", "score", "shard", "key", "h", "band", "start", "ids", "copies", "part", "words", "pii", "variant", "seen", "place", "m_block")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("own") for c in CLASH}).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
