"""Token store and packing against whole-text encoding."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from embermill.llm import packing, token_store
from embermill.llm.encoding import PieceEncoder
from embermill.llm.queries import vocabulary
from embermill.llm.shared import new_path

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ENCODERS = {name: PieceEncoder(vocabulary(name)) for name in (WORD, BYTE)}
PLAIN = {name: Tokenizer.from_str(vocabulary(name)) for name in (WORD, BYTE)}


def plain(name, texts):
    """Ids by the library alone, each text on its own."""
    return [np.array(PLAIN[name].encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n a", "a\n", "a\n b", "x.\nNew", "<|endoftext|> x <|endoftext|>", "don't 's 'S  12 3,4", "İ Σας ΟΔΟΣ",
       "é ́a", "a\x1c b", "　x 0 y", "!, ?. ...", "0 0 00", "A,b;C:d! e?", "İ. a\x85b", "tab\tend ", "q\x000 z"]


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_pieces_are_the_whole(name):
    e = ENCODERS[name]
    assert e.mode != "whole"
    assert e.encode(ODD) == plain(name, ODD) == e.encode(ODD)


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_special_strings(name):
    """A plain encode gives an added token's string its id; as text on demand."""
    text = "a <|endoftext|> x<|startoftext|> <|ENDOFTEXT|> <| b"
    other = PieceEncoder(vocabulary(name), special_as_text=True)
    assert ENCODERS[name].encode(["b", text, "c"]) == plain(name, ["b", text, "c"])
    end = PLAIN[name].token_to_id("<|endoftext|>")
    assert end in np.frombuffer(ENCODERS[name].encode([text])[0], "<u4")
    assert end not in np.frombuffer(other.encode([text])[0], "<u4")


def test_cache_is_bounded_by_bytes(monkeypatch):
    from embermill.llm import encoding

    monkeypatch.setattr(encoding, "CACHE_BYTES", 5_000)
    e = PieceEncoder(vocabulary(BYTE))
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    assert e.encode(texts) == plain(BYTE, texts) == e.encode(texts)
    assert e.held <= 5_000 and len(e.cache) <= 5_000 // encoding.PIECE_BYTES + 1


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aAbß 0\n\t.,'!<|>é́İ\x1c　"), max_size=30), st.sampled_from([WORD, BYTE]))
def test_pieces_are_the_whole_on_any_text(text, name):
    e = ENCODERS[name]
    assert e.encode([text, "other", text]) == plain(name, [text, "other", text])


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    ids = np.random.default_rng(0).integers(0, 1 << 32, 1000, dtype=np.uint64).astype("<u4")
    for n in (0, 1, 7, 8, 100, 1000):
        payload, ends = token_store.pack_segment(ids[:n], 96, planes, 3)
        assert (token_store.unpack_segment(payload, ends, n, 96, planes) == ids[:n]).all()


def expected(docs, name, end):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    return [(d, np.frombuffer(i, "<u4").tolist() + [end]) for (d, _), i in zip(rows, plain(name, [t for _, t in rows]))]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_store_round_trip(spark, clashing, planes):
    path = new_path(spark, "test")
    token_store.write_store(clashing, path, vocabulary(WORD), planes=planes, block_ids=64, segment_ids=500)
    got = token_store.read_store(spark, path).orderBy("start").collect()
    want = expected(clashing, WORD, 2)
    assert sorted((repr(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == sorted((repr(d), i) for d, i in want)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


def test_store_of_nothing(empty):
    assert token_store.token_store_digest(empty, vocabulary(WORD)).count() == 0


def check_packing(pieces, want, capacity=2048):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault((repr(p["doc_id"]), p["doc_tokens"]), []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    assert sum(p["length"] for p in pieces) == sum(len(i) for _, i in want)
    ids = {}
    for d, i in want:
        ids.setdefault(repr(d), []).append(i)
    for p in pieces:
        assert any(zlib.crc32(np.array(i[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"] for i in ids[repr(p["doc_id"])])
    return 1 - sum(p["length"] for p in pieces) / (capacity * len(by_seq))


def test_packing_covers_every_id(clashing):
    want = expected(clashing, BYTE, 1)
    pieces = packing.packing_digest(clashing, vocabulary(BYTE), group_bytes=40_000, capacity=256).collect()
    assert check_packing(pieces, want, 256) < 0.1
    again = packing.packing_digest(clashing.repartition(3), vocabulary(BYTE), group_bytes=40_000, capacity=256).collect()
    key = lambda p: tuple(map(repr, p))
    assert sorted(map(key, pieces)) == sorted(map(key, again))


def test_packing_of_nothing(empty):
    assert packing.packing_digest(empty, vocabulary(BYTE)).count() == 0


def test_first_fit_tree_is_first_fit():
    r = random.Random(3)
    sizes = [r.randint(1, 100) for _ in range(300)]
    tree, free = packing.CapacityTree(len(sizes), 100), [100] * len(sizes)
    for s in sizes:
        want = next(i for i, f in enumerate(free) if f >= s)
        free[want] -= s
        assert tree.first_fit(s) == want


@pytest.mark.parametrize("lengths", [[1100] * 500, [2048] * 3, [0, 0], [], [1], [5000, 1, 2047], list(range(1, 2048))])
def test_packing_of_any_lengths(lengths):
    pieces, bins = packing.pack_lengths(lengths, 2048)
    assert bins <= -(-sum(lengths) // 2048) * 1.003 + 1
    covered = {}
    for item, start, n, _, _ in pieces:
        covered.setdefault(item, []).append((start, n))
    for item, n in enumerate(lengths):
        at = 0
        for start, k in sorted(covered.get(item, [])):
            assert start == at and k > 0
            at += k
        assert at == n


def test_pieces_are_cut_from_one_text_and_the_collector_rests():
    import gc

    import pyarrow as pa

    from embermill.llm import encoding, queries

    names = ["", "a", "\n", "é\n", "x,", "\u3000", "\t"]
    for kind in (names, names[1:], [""], []):
        assert encoding._strings(pa.array(kind, pa.string())) == kind
    enc = encoding.PieceEncoder(queries.vocabulary("byte_bpe_50k.json"))
    on, run = [], enc._run
    enc._run = lambda texts: on.append(gc.isenabled()) or run(texts)
    texts = ["", " ", "one  two", "a b,\nc é", "x <|endoftext|> y", "\n\n"]
    assert enc.encode(texts) == enc._whole(texts)
    assert on == [False] and gc.isenabled()
