"""The pipeline's stages on a small corpus, each against its operator's brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import DOC, prose
from .test_links import near_copies, shingles


def tables(spark, folder):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        w = prose(r, r.randint(10, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["grumbolt", "snarfik"]))
        text = " ".join(w) + (" mail a.b@c.example now" if i % 7 == 0 else "")
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + d, t, "en", "s1", 0) for d, t, *_ in near_copies(2, 3, 10)] + [(2000, None, None, None, None), (2001, "", "en", "s0", 0)]
    spark.createDataFrame(docs, DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, dict((d, t) for d, _, t in labels)


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs, toxic = tables(spark, folder)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        steps.append({(r["doc_id"], r["text"]) for r in now.collect()})
    clean, single, redacted, mixed = steps
    left = {x for x, _ in clean}
    assert sum(d not in left for d, t in toxic.items() if not t) <= 10 and sum(d in left for d, t in toxic.items() if t) <= 24
    assert {(2000, None), (2001, "")} <= clean
    assert single <= clean
    sets = [shingles(t, 5) for d, t in single]
    assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    for d, t in clean - single:
        a = shingles(t, 5)
        assert any(100 * len(a & shingles(u, 5)) >= 80 * len(a | shingles(u, 5)) for e, u in clean if e != d)
    assert {d for d, _ in redacted} == {d for d, _ in single} and not any("@" in (t or "") for _, t in redacted)
    assert {d for d, _ in mixed} <= {d for d, _ in redacted}
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    assert pieces.where("offset + length > 2048").count() == 0
    want = now.count()
    assert pieces.where("start = 0").count() == want


def test_run_is_the_stages(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    a = corpus_pipeline.run(spark, folder).agg(F.count("*"), F.bit_xor("ids_crc32")).first()
    b = corpus_pipeline.run(spark, folder).agg(F.count("*"), F.bit_xor("ids_crc32")).first()
    assert tuple(a) == tuple(b) and a[0] > 0


def test_stages_on_nothing_and_with_clashing_columns(spark, tmp_path, empty, clashing):
    """Each stage alone: an empty table, then nulls, repeats and columns of the operators' own names; no labels at all."""
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
        out = stage(spark, clashing, folder)
        rows = out.collect()
        assert len({repr(r["doc_id"]) for r in rows}) > 1
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        if name in ("toxicity", "pii"):
            assert len(rows) == clashing.count()


def test_stages_bound_what_workers_hold(spark, tmp_path):
    """Long texts cross in batches bounded by bytes, and packing leaves no encoder in a worker that lives on."""
    from embermill.llm import packing
    from embermill.llm.queries import vocabulary

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = [(i, f"word{i} " * 30_000, "en", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, DOC).coalesce(1)
    try:
        corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))

        def sizes(batches):
            for b in batches:
                yield type(b).from_pydict({"n": [b.nbytes]})

        most = docs.select("text").mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
        assert most <= 2 * corpus_pipeline.BATCH_BYTES < sum(len(r[1]) for r in rows)

        pieces = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))
        whole = packing.packing_digest(docs, vocabulary("byte_bpe_50k.json"), end_id=1)
        assert pieces.exceptAll(whole).count() == 0 == whole.exceptAll(pieces).count()

        def held(batches):
            from embermill.llm import encoding

            for b in batches:
                yield type(b).from_pydict({"n": [sum(not k.endswith(" None") for k in encoding._ENCODERS)]})

        assert spark.range(64).repartition(16).mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0
    finally:
        spark.conf.set(key, before)
    from embermill.llm import encoding

    enc = encoding.encoder(vocabulary("byte_bpe_50k.json"), cache_bytes=5_000)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    enc.encode(texts)
    assert 0 < enc.held <= 5_000
