"""Exact text encoding with the ``tokenizers`` library through a piece cache.

A text is cut at single ASCII spaces, each distinct piece is encoded once per
worker and the ids are joined.  That is the same as encoding the whole text
wherever a space is always a boundary of the tokenizer's own pre-split; texts
where it may not be (runs of white space, for byte-level vocabularies), texts
that may hold the string of an added token (which a plain encode gives that
token's id, unless ``special_as_text``) and tokenizers of any other make are
encoded whole.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Memory of the pieces that a worker keeps, by the sizes of Python's objects; others are encoded once
#: for each run of texts (speed only, never results).
CACHE_BYTES = 160_000_000
PIECE_BYTES = 170  # of a piece, its ids and its place in the cache, without their letters and ids
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt(-8, 1)  # M_ARENA_MAX: one heap, so that trimming gives all of it back
except OSError:
    _LIBC = None
_ENCODERS: dict[str, "PieceEncoder"] = {}


def lean() -> None:
    """Let this worker allocate from the system, which takes freed memory back at once."""
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())


def forget_encoders() -> None:
    """Before other work: a worker that lives on gives up its tokenizers and their caches."""
    lean()
    _ENCODERS.clear()
    _give_back()


def encoder(tokenizer_json: str, special_as_text: bool = False, cache_bytes: int | None = None) -> "PieceEncoder":
    """This worker's encoder; it keeps one, and gives up any other with its cache."""
    lean()
    key = f"{hash(tokenizer_json)} {special_as_text} {cache_bytes}"
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(tokenizer_json, special_as_text, cache_bytes)
    return _ENCODERS[key]


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id behind each text's ids."""
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


class PieceEncoder:
    """Ids of whole texts; ``flat`` gives one array for a run of texts."""

    def __init__(self, tokenizer_json: str, special_as_text: bool = False, cache_bytes: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = special_as_text
        spec = json.loads(tokenizer_json)
        self.mode = _mode(spec)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        #: What every added token's string starts with, if that is no letter: texts without it hold none.
        self.guard = os.path.commonprefix(added) if added and not special_as_text else ""
        if added and not special_as_text and (not self.guard or self.guard != self.guard.lower() or self.guard[0].isalnum()):
            self.mode = "whole"
        self.cache: dict[str, bytes | None] = {}
        self.held = 0
        self.cache_bytes = CACHE_BYTES if cache_bytes is None else cache_bytes
        self.marks = {"": b""} | {m: self._whole([m])[0] for m in ",.;:!?"}
        self.line = self._whole(["\n"])[0]
        self.between = -1
        self.bare = None
        if self.mode == "words":
            from tokenizers import pre_tokenizers as pt

            self.bare = Tokenizer.from_str(tokenizer_json)
            self.bare.encode_special_tokens = special_as_text
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pt.Sequence(
                [pt.WhitespaceSplit(), pt.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
        if self.mode != "whole":
            one = self._whole(["0" if self.mode == "words" else " 0"])[0]
            self.between = int(np.frombuffer(one, "<u4")[0]) if len(one) == 4 else -1

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian uint32 bytes."""
        out: list[bytes] = []
        for ids, ends in self.flat(pa.array(texts, pa.string())):
            raw, at = memoryview(ids.tobytes()), 0
            for end in ends.tolist():
                out.append(bytes(raw[4 * at : 4 * end]))
                at = end
        return out

    def flat(self, texts: pa.Array, run_bytes: int = 6_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of texts: (ids of all of them, end of each text's ids)."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        start = 0
        while start < len(texts):
            n = int(np.searchsorted(np.cumsum(sizes[start:]), run_bytes)) + 1
            on = gc.isenabled()
            gc.disable()  # hundreds of thousands of new pieces, no cycles among them
            try:
                out = self._guarded(texts.slice(start, n))
            finally:
                if on:
                    gc.enable()
            yield out
            del out
            _give_back()
            start += n

    def _guarded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``_run`` for the texts that hold no added token's string; the others whole."""
        if self.mode == "whole" or not self.guard:
            return self._run(texts)
        special = pc.match_substring(texts, self.guard)
        if not pc.any(special).as_py():
            return self._run(texts)
        ids, ends = self._run(pc.if_else(special, "", texts))
        each = np.split(ids, ends[:-1])
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            each[i] = np.frombuffer(self._whole([texts[i].as_py()])[0], "<u4")
        return np.concatenate(each), np.cumsum([len(e) for e in each])

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.mode == "whole":
            each = self._whole(texts.to_pylist())
            return np.frombuffer(b"".join(each), "<u4"), np.cumsum([len(e) // 4 for e in each])
        if self.mode == "words":
            # The tokenizer lowers letters itself: done first, it makes fewer pieces.
            cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        else:
            cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        names, at = _strings(coded.dictionary), coded.indices.to_numpy().copy()
        ends = np.cumsum(pc.list_value_length(cut).to_numpy())
        starts = np.concatenate([[0], ends[:-1]])
        spare = self._learn(names)
        each = list(map(self.cache.__getitem__, names))
        for piece in spare:
            self.cache.pop(piece, None)
        odd: list[int] = []
        if self.mode == "leading":
            firsts = [names[i] for i in at[starts].tolist()]
            if None in each:
                bad = np.fromiter((e is None for e in each), bool, len(each))
                hit = bad[at]
                hit[starts] = [n > 1 and f[-1:].isspace() for f, n in zip(firsts, (ends - starts).tolist())]
                odd = np.flatnonzero(np.logical_or.reduceat(hit, starts)).tolist()
                each = [e or b"" for e in each]
            at[starts] = len(each) + np.arange(len(texts))
            heads = self._whole(firsts)
            for i in odd:  # a piece of these touches other white space
                heads[i] = self._whole([texts[i].as_py()])[0]
            each += heads
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        if odd:
            skip = np.zeros(len(at), bool)
            for i in odd:
                skip[starts[i] + 1 : ends[i]] = True
            each.append(b"")
            sizes = np.append(sizes, 0)
            at[skip] = len(each) - 1
        lists = pa.ListArray.from_arrays(
            np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32),
            pa.array(np.frombuffer(b"".join(each), "<u4")),
        )
        ids = lists.take(pa.array(at)).flatten().to_numpy()
        total = np.concatenate([[0], np.cumsum(sizes[at])])
        return ids, total[ends]

    def _learn(self, pieces: list[str]) -> list[str]:
        """Cache the pieces; gives those to forget again after this run.

        A word with one mark behind it, or a line's last and the next line's first
        word, are their parts' ids: letters, marks and a single line feed between
        them are apart in every pre-split that this class takes.
        """
        cache, marks, plain = self.cache, self.marks, self.mode == "words"
        new = [p for p in pieces if p not in cache]
        made, stems, heads = [], set(), set()
        for p in new:
            if p.isalpha():
                stems.add(p)
                continue
            mark = p[-1:]
            if mark in marks and _letters(p[:-1]):
                made.append((p, p[:-1], marks[mark], None))
                stems.add(p[:-1])
            elif "\n" in p:
                left, _, right = p.partition("\n")
                mark = left[-1:] if left[-1:] in marks else ""
                stem = left[: len(left) - len(mark)]
                if _letters(stem) and _letters(right):
                    made.append((p, stem, marks[mark] + self.line, right))
                    stems.add(stem)
                    heads.add(right)
                else:
                    stems.add(p)
            else:
                stems.add(p)
        stems = {p for p in stems if p not in cache}
        if "" in stems:
            stems.discard("")
            cache[""] = b"" if plain else None  # next to another space: not a boundary
        order = list(stems)
        if not plain:
            spaced = {p for p in order if not p.isalpha() and (p[0].isspace() or p[-1].isspace())}
            cache.update(dict.fromkeys(spaced))
            order = [p for p in order if p not in spaced]
        head_ids = dict(zip(heads, self._whole(list(heads))))
        for i in range(0, len(order), 20_000):
            part = order[i : i + 20_000]
            cache.update(zip(part, self._apart(part)))
        for p, stem, mark, head in made:
            cache[p] = cache[stem] + mark + (head_ids[head] if head else b"")
        spare = []
        for p in stems.union(new):
            size = PIECE_BYTES + len(p) + len(cache[p] or b"")
            if self.held + size > self.cache_bytes:
                spare.append(p)
            else:
                self.held += size
        return spare

    def _apart(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids, by encoding runs of pieces with a digit between them.

        Plain lower-case words of a tokenizer that drops white space need neither
        its normalizer nor its pre-split: they go to its model directly.
        """
        lead = "" if self.mode == "words" else " "
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[str, list[int]] = {"plain": [], "rest": [], "odd": []}
        for i, p in enumerate(pieces):
            if "0" in p or not p.isprintable() or p.isspace():
                groups["odd"].append(i)
            elif self.bare is not None and p.isascii() and p.isalpha():
                groups["plain"].append(i)
            else:
                groups["rest"].append(i)
        for i, ids in zip(groups["odd"], self._whole([lead + pieces[i] for i in groups["odd"]])):
            out[i] = ids
        for name, tokenizer in (("plain", self.bare), ("rest", self.tokenizer)):
            runs = [groups[name][k : k + 200] for k in range(0, len(groups[name]), 200)]
            if not runs:
                continue
            texts = [lead + " 0 ".join([pieces[i] for i in run]) for run in runs]
            for run, e in zip(runs, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(ids == self.between)
                if len(ends) != len(run) - 1:
                    for i, own in zip(run, self._whole([lead + pieces[i] for i in run])):
                        out[i] = own
                    continue
                raw, at = ids.tobytes(), 0
                for i, end in zip(run, [*ends.tolist(), len(ids)]):
                    out[i] = raw[4 * at : 4 * end]
                    at = end + 1
        return out


def _strings(pieces: pa.Array) -> list[str]:
    """The pieces, none of which holds a space, as Python strings: one text cut at spaces is faster than one by one."""
    if not len(pieces):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
    return pc.binary_join(whole, " ")[0].as_py().split(" ")


def _letters(word: str) -> bool:
    """Letters alone, and still so in lower case (a letter's lower case may hold a mark)."""
    return word.isalpha() and (word.isascii() or word.lower().isalpha())


def _give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks."""
    lean()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _mode(spec: dict) -> str:
    """``words``: white space is dropped; ``leading``: a space belongs to the next word; else ``whole``."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec.get("post_processor") not in (None, {}) and (spec["post_processor"] or {}).get("type") not in ("ByteLevel",):
        return "whole"
    if (
        pre.get("type") == "ByteLevel"
        and pre.get("use_regex")
        and not pre.get("add_prefix_space")
        and norm is None
    ):
        return "leading"
    if norm and pre.get("type") == "Sequence" and norm.get("type") == "Sequence":
        first = pre["pretokenizers"][0]
        kinds = [n.get("type") for n in norm["normalizers"]]
        drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
        spaced = all(k in ("NFC", "Replace", "Lowercase") for k in kinds)
        if drops and spaced and "[^\\s" in json.dumps(first["pattern"]).replace("\\\\", "\\"):
            return "words"
    return "whole"
