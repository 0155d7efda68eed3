"""Removal of byte strings that an earlier document has, by anchors and hashes.

This is not bucket-pointer refinement, which sorts each bucket of suffixes by the buckets of
later offsets, again and again, and so needs every suffix in every round. Of the q-grams
within a string of 50 bytes the one with the smallest hash, the anchor, is the same wherever
the string stands. So only anchors are looked at, and each stands for the run of suffixes
that share it; hashes of the bytes around it take the place of later buckets.

1. Runs of q-grams that several documents have. Those of a q-gram are told apart by the
   bytes of the whole run, its context: a run whose context an earlier document has is
   removed at once, and is needed no more.
2. The first document's run of each context is told apart from others once more: by the
   bytes before or after the anchor, and where several documents have these, string by string.

Keys are values (q-gram and context, q-gram and string), never a whole bucket, and only the
smallest document of a key is asked for. So tasks combine before they shuffle: of a key only
the smallest document's rows go on, and a q-gram that is everywhere is as many small groups as
it has contexts. Which q-grams, halves and runs the next step needs is told by Bloom filters of
fixed size: a wrong yes costs time only. Rows travel as arrays, by ranges of their keys.

Every key has its q-gram, so large inputs take the steps in passes, each for a share of the
q-grams: what a pass writes out is a share of what all would, and so are its filters' entries.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revsync import session
from revsync.llm import bloom
from revsync.llm.common import runs as by_key, scoped, stage

#: Bytes of a q-gram, of a string that counts, of text that is hashed at once, 1 << 16 at most.
GRAM, LENGTH, BLOCK = 16, 50, 1 << 15
#: Bytes next to an anchor by which runs are told apart before their strings are.
HALF = (LENGTH - GRAM) // 2
#: Anchors that a task combines before it hands them on; log2 of the ranges of keys by which
#: it does, each of which is looked at alone.
HELD, RANGES = 200_000, 12
#: Runs of all texts for which one pass is made, and passes at most. A pass writes out at most
#: some 75 bytes for each of its runs, and there is a run for every 17 bytes of text.
PASS, PASSES = 60_000_000, 4
#: Rows of a batch that are taken out of it at once.
ROWS = 256

_BASE = 0x9E3779B97F4A7C15
_ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: How columns travel. A document is two of them, of which the upper is mostly zeros.
_KIND = {k: np.uint64 for k in ("key", "q", "left", "right", "name")}
_KIND |= {"low": np.uint32, "high": np.int32, "version": np.int32, "lo": np.int32, "n": np.uint8, "has": np.uint8}
#: Where a run is.
_PLACE = ("low", "high", "version", "lo", "n")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    return x ^ (x >> np.uint64(29))


class Text:
    """Hashes of the substrings of a buffer, each from two prefix sums."""

    def __init__(self, size: int):
        powers = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)])
        self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))
        self.byte = _mix(np.arange(1, 257, dtype=np.uint64))

    def load(self, data: bytes) -> None:
        b = np.frombuffer(data, np.uint8)
        self.n = len(b)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.byte[b] * self.up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.down[start])

    def each(self, length: int) -> np.ndarray:
        """Of all substrings of a length what `of` mixes."""
        n = self.n - length + 1
        sums = self.sums[length:] - self.sums[:n]
        sums *= self.down[:n]
        return sums


class Runs:
    """Runs of suffixes with one anchor, as columns."""

    def __init__(self):
        self.text = Text(BLOCK + 1)
        self.places = np.arange(BLOCK + 1, dtype=np.uint32)

    def blocks(self, rows):
        """Texts by blocks: bytes, and of each piece its end, document and offset. A text longer
        than a block is taken in pieces that overlap by a string less a byte."""
        parts: list[bytes] = []
        of: list[tuple[int, int, int, int]] = []
        size = 0
        for doc, version, data in rows:
            for at in range(0, max(len(data) - LENGTH + 1, 0), BLOCK - LENGTH + 1):
                piece = data[at : at + BLOCK]
                if size + len(piece) > BLOCK:
                    yield b"".join(parts), of
                    parts, of, size = [], [], 0
                parts.append(piece)
                size += len(piece)
                of.append((size, doc, version, at))
        if parts:
            yield b"".join(parts), of

    def of(self, data: bytes, of, wanted=None) -> dict[str, np.ndarray]:
        """The runs of a block, those whose q-grams are `wanted`. `lo` is a run's first suffix in
        the document, `n` their number, `off` from there to the anchor; `at` is `lo` in the block."""
        self.text.load(data)
        ends, docs, versions, offsets = (np.array(c, np.int64) for c in zip(*of))
        grams = self.text.each(GRAM)
        # Smallest upper 16 bits, then leftmost; the place stands in the low bits.
        low = (grams >> np.uint64(32)).astype(np.uint32)
        low &= np.uint32(0xFFFF0000)
        low |= self.places[: len(low)]
        width, have = LENGTH - GRAM + 1, 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        at = np.append(0, np.flatnonzero(low[1:] != low[:-1]) + 1)
        a = (low[at] & np.uint32(0xFFFF)).astype(np.int64)
        # Up to the end of the anchor's text, which no string may cross.
        piece = np.searchsorted(ends, a, side="right")
        start = np.append(0, ends[:-1])[piece]
        end = np.minimum(np.append(at[1:], len(low)), ends[piece] - LENGTH + 1)
        at = np.maximum(at, start)
        q = _mix(grams[a])
        some = end > at
        if wanted is not None:
            some &= wanted(q)
        q, a, at, end, piece, start = (x[some] for x in (q, a, at, end, piece, start))
        n, off = end - at, a - at
        ctx = self.text.of(at, n + LENGTH - 1) ^ _mix((off + 1).astype(np.uint64))
        return {
            "q": q, "ctx": ctx, "doc": docs[piece],
            "version": versions[piece], "lo": at - start + offsets[piece], "n": n, "off": off, "at": at,
        }

    def has(self, c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Which runs have suffixes HALF bytes or more before the anchor, and which nearer ones."""
        return c["off"] >= HALF, c["off"] - c["n"] + 1 < HALF

    def halves(self, c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the HALF bytes before the anchor with it, and of it with the HALF bytes
        after: the former is in every string that starts HALF bytes or more before the anchor,
        the latter in every other. Of no meaning where a run has no such string."""
        a, size = c["at"] + c["off"], HALF + GRAM
        return tuple(self.text.of(np.clip(x, 0, max(self.text.n - size, 0)), size) for x in (a - HALF, a))

    def strings(self, at: np.ndarray) -> np.ndarray:
        return self.text.of(at, LENGTH)


def _spans(doc, version, lo, hi):
    """(doc, version, lo, hi) with spans of a document that touch put together."""
    if not len(doc):
        return doc, version, lo, hi
    o = np.lexsort((lo, version, doc))
    doc, version, lo, hi = doc[o], version[o], lo[o], hi[o]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
    group = np.cumsum(fresh) - 1
    far = np.maximum.accumulate(hi + group * (1 << 40)) - group * (1 << 40)
    fresh[1:] |= lo[1:] > far[:-1]
    at = np.flatnonzero(fresh)
    return doc[at], version[at], lo[at], np.maximum.reduceat(hi, at)


def _ends(q: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of `q`, ascending, and of each its smallest and largest document."""
    if not len(q):
        return q, doc, doc
    o = np.argsort(q)
    q, doc = q[o], doc[o]
    new = np.append(True, q[1:] != q[:-1])
    at, several = np.flatnonzero(new), ~(new & np.append(new[1:], True))
    low, high, size = doc[at], doc[at], np.diff(at, append=len(q))
    if several.any():  # most stand alone
        more, doc = np.flatnonzero(size > 1), doc[several]
        start = np.cumsum(size[more]) - size[more]
        low[more], high[more] = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start)
    return q[at], low, high


def _packed(q: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """(part, q, doc): by range of q-grams, the bytes of these and of the smallest and, if that
    is another, the largest document of each."""
    q, low, high = _ends(q, doc)
    n = 1 + (high > low)
    doc, last = np.repeat(low, n), np.cumsum(n) - 1
    doc[last] = high
    q = np.repeat(q, n)
    part = (q >> np.uint64(64 - RANGES)).astype(np.int32)
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(q) else np.zeros(0, np.int64)
    offsets = pa.py_buffer(np.append(at * 8, len(q) * 8).astype(np.int32))
    columns = [pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(c)]) for c in (q, doc)]
    return pa.RecordBatch.from_arrays([pa.array(part[at]), *columns], names=["part", "q", "doc"])


def _name(c: dict[str, np.ndarray]) -> np.ndarray:
    """The number of a run in the Bloom filter, but for which side of its anchor is meant."""
    return _mix(c["q"] ^ _mix(c["ctx"] ^ _mix(c["doc"].astype(np.uint64))))


def _side(name: np.ndarray, side: int) -> np.ndarray:
    """The number of a run's left (0) or right (1) half."""
    return _mix(name + np.uint64(side))


def _few(batches):
    """The batches' rows, some at a time, since texts take more room in Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def _rows(batches):
    for batch in _few(batches):
        for doc, version, text in zip(*(batch.column(i).to_pylist() for i in range(2)), _bytes(batch.column(2))):
            yield doc, version, text or b""


def _gathered(some, held: int):
    """Columns put together until they have `held` rows or more."""
    parts, n = [], 0
    for c in some:
        parts.append(c)
        n += len(c["doc"])
        if n >= held:
            yield {k: np.concatenate([p[k] for p in parts]) for k in c}
            parts, n = [], 0
    if n:
        yield {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _halved(doc: np.ndarray) -> dict[str, np.ndarray]:
    return {"low": doc.astype(np.uint32), "high": (doc >> 32).astype(np.int32)}


def _doc(c: dict[str, np.ndarray]) -> np.ndarray:
    return c["high"].astype(np.int64) << 32 | c["low"].astype(np.int64)


def _late(key: np.ndarray, q: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by key and q-gram, and which of them, in that order, have a document
    larger than the smallest with the same two."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    o = np.argsort(key)
    same, other = (x[o][1:] == x[o][:-1] for x in (key, q))
    if (same & ~other).any():  # hardly ever, since a key is a hash
        o = np.lexsort((q, key))
        same, other = (x[o][1:] == x[o][:-1] for x in (key, q))
    at = np.flatnonzero(np.append(True, ~(same & other)))
    doc = doc[o]
    return o, doc > np.repeat(np.minimum.reduceat(doc, at), np.diff(at, append=len(o)))


def _cut(c: dict[str, np.ndarray], names, at: np.ndarray) -> list[pa.Array]:
    """The bytes of columns, cut at the places `at`, which has the last row's end, too."""
    out = []
    for k in names:
        data = np.ascontiguousarray(c[k], _KIND[k])
        offsets = pa.py_buffer((at * data.itemsize).astype(np.int32))
        out.append(pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, offsets, pa.py_buffer(data)]))
    return out


def _read(columns, names) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(x, _KIND[k]) for k, x in zip(names, columns)}


def _sent(c: dict[str, np.ndarray], names) -> pa.RecordBatch:
    """(part, `names`, places): by range of keys, the rows that none here is earlier than, and
    the places of the others, which are `late` already."""
    o, late = _late(c["key"], c["q"], c["doc"])
    c = {k: v[o] for k, v in (c | _halved(c["doc"])).items()}
    part = (c["key"] >> np.uint64(64 - RANGES)).astype(np.int32)
    early = part[~late]
    at = np.flatnonzero(np.append(True, early[1:] != early[:-1]))
    gone = np.append(np.searchsorted(part[late], early[at]), np.count_nonzero(late))
    columns = _cut({k: c[k][~late] for k in names}, names, np.append(at, len(early)))
    columns += _cut({k: c[k][late] for k in _PLACE}, _PLACE, gone)
    return pa.RecordBatch.from_arrays(
        [pa.array(early[at]), *columns], names=["part", *names, *(f"late_{k}" for k in _PLACE)]
    )


def _met(batches, names):
    """What `_sent` of all tasks comes to, range by range: the rows that no other is earlier
    than, and the places of all others."""
    for _, some in by_key(batches):
        columns = [b"".join(x) for x in zip(*some)]
        c, gone = _read(columns, names), _read(columns[len(names) :], _PLACE)
        o, late = _late(c["key"], c["q"], _doc(c))
        c = {k: v[o] for k, v in c.items()}
        yield {k: v[~late] for k, v in c.items()}, {k: np.concatenate([v, c[k][late]]) for k, v in gone.items()}


def _schema(*names: str) -> str:
    return ", ".join(f"{k} binary" for k in names)


def _by_range(rows: DataFrame) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part")


def _row(c: dict[str, np.ndarray], names) -> list[pa.Array]:
    """Columns as the bytes of one row."""
    return [pa.array([np.ascontiguousarray(c[k], _KIND[k]).tobytes()], pa.binary()) for k in names]


def _anchors(texts: DataFrame) -> DataFrame:
    """(part, q, runs): by range, the q-grams that are anchors in several documents; the `runs`
    add up to those of all texts."""

    def pack(batches):
        runs = Runs()
        for c in _gathered((runs.of(*block) for block in runs.blocks(_rows(batches))), HELD):
            batch = _packed(c["q"], c["doc"])
            yield batch.append_column("runs", pa.array([len(c["q"])] + [0] * (batch.num_rows - 1), pa.int64()))

    def shared(batches):
        for part, some in by_key(batches):
            q, doc, runs = zip(*some)
            q, low, high = _ends(np.frombuffer(b"".join(q), np.uint64), np.frombuffer(b"".join(doc), np.int64))
            row = [pa.array([part], pa.int32()), *_row({"q": q[low < high]}, ["q"]), pa.array([sum(runs)], pa.int64())]
            yield pa.RecordBatch.from_arrays(row, names=["part", "q", "runs"])

    packed = texts.mapInArrow(pack, "part int, q binary, doc binary, runs long")
    return stage(_by_range(packed).mapInArrow(shared, "part int, q binary, runs long"), "suffix-anchors")


def _arrays(batches):
    for batch in batches:
        for x in batch.column(0).to_pylist():
            yield np.frombuffer(x, np.uint64)


_RUN = ("key", "q", "left", "right", "low", "high", "version", "lo", "n", "has")
#: Of runs of which none is earlier.
_ALIVE = ("name", "left", "right", "low", "high", "has")


def _first(texts: DataFrame, wanted) -> DataFrame:
    """Step 1: by range, the `_ALIVE` of the runs of wanted q-grams whose context no earlier
    document has, and the places of the others."""

    def found(batches):
        runs = Runs()
        for block in runs.blocks(_rows(batches)):
            c = runs.of(*block, wanted)
            (left, right), (has_left, has_right) = runs.halves(c), runs.has(c)
            c |= {"key": c["ctx"], "left": left, "right": right, "has": has_left + 2 * has_right.astype(np.uint8)}
            yield {k: c[k] for k in ("key", "q", "left", "right", "doc", "version", "lo", "n", "has")}

    def pack(batches):
        for c in _gathered(found(batches), HELD):
            yield _sent(c, _RUN)

    def judge(batches):
        for c, gone in _met(batches, _RUN):
            c["name"] = _name({"q": c["q"], "ctx": c["key"], "doc": _doc(c)})
            yield pa.RecordBatch.from_arrays(
                _row(c, _ALIVE) + _row(gone, _PLACE), names=[*_ALIVE, *(f"late_{k}" for k in _PLACE)]
            )

    late = [f"late_{k}" for k in _PLACE]
    sent = texts.mapInArrow(pack, "part int, " + _schema(*_RUN, *late))
    return stage(_by_range(sent).mapInArrow(judge, _schema(*_ALIVE, *late)), "suffix-contexts")


def _second(texts: DataFrame, first: DataFrame, wanted) -> DataFrame:
    """Step 2: the places of strings, of the runs that step 1 left, that an earlier document has."""
    alive = first.select(*_ALIVE)

    def halves(batches):
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                c = _read(row, _ALIVE)
                yield c["name"], _doc(c), [(c[k], c["has"] >> side & 1 > 0) for side, k in enumerate(("left", "right"))]

    def pack(batches):
        some = (
            {"half": half[has], "doc": doc[has]} for _, doc, sides in halves(batches) for half, has in sides
        )
        for c in _gathered(some, HELD):
            yield _packed(c["half"], c["doc"])

    def several(batches):
        for _, some in by_key(batches):
            half, doc = zip(*some)
            half, low, high = _ends(np.frombuffer(b"".join(half), np.uint64), np.frombuffer(b"".join(doc), np.int64))
            yield half[low < high]

    shared = bloom.build(_by_range(alive.mapInArrow(pack, "part int, half binary, doc binary")), several)

    def names(batches):
        for name, _, sides in halves(batches):
            for side, (half, has) in enumerate(sides):
                yield _side(name[has & bloom.among(shared.value, half)], side)

    likely = bloom.build(alive, names)
    columns = ("key", "q", *_PLACE)

    def strings(batches):
        runs = Runs()
        for block in runs.blocks(_rows(batches)):
            c = runs.of(*block, wanted)
            name = _name(c)
            sides = [bloom.among(likely.value, _side(name, side)) & has for side, has in enumerate(runs.has(c))]
            some = sides[0] | sides[1]
            c = {k: v[some] for k, v in c.items()}
            n = c["n"]
            at = _each(c["at"], n)
            back = np.repeat(c["at"] + c["off"], n) - at  # how far before the anchor
            which = np.where(back >= HALF, np.repeat(sides[0][some], n), np.repeat(sides[1][some], n))
            at = at[which]
            c = {k: np.repeat(c[k], n)[which] for k in ("q", "doc", "version")} | {"lo": _each(c["lo"], n)[which]}
            yield c | {"key": runs.strings(at), "n": np.ones(len(at), np.uint8)}

    def sent(batches):
        for c in _gathered(strings(batches), HELD):
            yield _sent(c, columns)

    def judge(batches):
        for _, gone in _met(batches, columns):
            yield pa.RecordBatch.from_arrays(_row(gone, _PLACE), names=list(_PLACE))

    rows = texts.mapInArrow(sent, "part int, " + _schema(*columns, *(f"late_{k}" for k in _PLACE)))
    return stage(_by_range(rows).mapInArrow(judge, _schema(*_PLACE)), "suffix-second")


def _each(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for n places, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _covers(places: DataFrame) -> DataFrame:
    """(doc, version, lo, hi): of each text the spans that the strings at its places cover."""

    def read(batches):
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                c = _read(row, _PLACE)
                yield c | {"doc": _doc(c)}

    def pack(batches):
        for c in _gathered(read(batches), HELD):
            part = (_mix(c["doc"].astype(np.uint64)) >> np.uint64(64 - RANGES)).astype(np.int32)
            o = np.argsort(part, kind="stable")
            part = part[o]
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            columns = _cut({k: c[k][o] for k in _PLACE}, _PLACE, np.append(at, len(part)))
            yield pa.RecordBatch.from_arrays([pa.array(part[at]), *columns], names=["part", *_PLACE])

    def put_together(batches):
        for _, some in by_key(batches):
            c = _read([b"".join(x) for x in zip(*some)], _PLACE)
            lo = c["lo"].astype(np.int64)
            doc, version, lo, hi = _spans(_doc(c), c["version"].astype(np.int64), lo, lo + c["n"] + LENGTH - 1)
            at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])))
            ends = pa.array(np.append(at, len(doc)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (lo, hi)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[at]), pa.array(version[at]), *lists], names=["doc", "version", "lo", "hi"]
            )

    packed = _by_range(places.mapInArrow(pack, "part int, " + _schema(*_PLACE)))
    return packed.mapInArrow(put_together, "doc long, version long, lo array<long>, hi array<long>")


def _passed(texts: DataFrame, anchors: DataFrame, low: int, high: int) -> DataFrame:
    """What goes by the q-grams in the ranges from `low` up to `high`, as `_covers`."""
    there = bloom.build(anchors.where(F.col("part").between(low, high - 1)).select("q"), _arrays)

    def wanted(q):
        part = q >> np.uint64(64 - RANGES)
        return (part >= low) & (part < high) & bloom.among(there.value, q)

    with scoped(texts.sparkSession) as keep:
        first = _first(texts, wanted)
        gone = first.select(*(F.col(f"late_{k}").alias(k) for k in _PLACE))
        return keep(_covers(gone.unionAll(_second(texts, first, wanted))), "suffix-pass")


def _versions(docs: DataFrame) -> DataFrame:
    """`docs` (id, text) with `version`: 0, or which of its texts an id that has several has."""
    kinds = docs.where("id is not null").select("id", F.xxhash64("text").alias("h"))
    kinds = kinds.groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    several = stage(kinds.where("lo <> hi").select(F.col("id").alias("i")), "suffix-several")
    if several.isEmpty():
        return docs.withColumn("version", F.lit(0).cast("long"))
    texts = docs.join(several, F.col("id") == F.col("i"), "left_semi")
    hashes = texts.groupBy("id").agg(F.sort_array(F.collect_set(F.xxhash64("text"))).alias("hashes"))
    hashes = stage(hashes.withColumnRenamed("id", "i"), "suffix-versions")
    number = F.coalesce(F.array_position("hashes", F.xxhash64("text")), F.lit(0))
    joined = docs.join(hashes, F.col("id") == F.col("i"), "left")
    return joined.select("id", "text", number.cast("long").alias("version"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: its id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes).

    A byte goes if a string of 50 bytes that covers it also starts in a document with a
    smaller id, both judged on the input. Ids are integers. Null and empty texts have no
    bytes. A row without an id is neither earlier nor later than any other and loses
    nothing; rows that share an id are not earlier than each other. Other columns are left
    out.
    """
    rows = _versions(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")))
    texts = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= LENGTH)).select("id", "version", "text")
    with scoped(docs.sparkSession) as keep, session.hash_joins(docs.sparkSession):
        anchors = _anchors(texts)
        passes = min(PASSES, max(1, -(-(anchors.agg(F.sum("runs")).first()[0] or 0) // PASS)))
        ends = [(k << RANGES) // passes for k in range(passes + 1)]
        covers = [_passed(texts, anchors, *two) for two in zip(ends, ends[1:])]
        covers = reduce(DataFrame.unionAll, covers).groupBy("doc", "version")
        covers = covers.agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("lo", "hi")))
        covers = keep(covers, "suffix-covers")
    joined = rows.join(
        covers.withColumnRenamed("version", "v"), (F.col("id") == F.col("doc")) & (F.col("version") == F.col("v")), "left"
    ).select("id", "text", "lo", "hi")

    def remove(batches):
        for batch in _few(batches):
            out: list[list] = [[], [], [], [], []]
            doc_ids, los, his = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for doc, t, lo, hi in zip(doc_ids, _bytes(batch.column(1)), los, his):
                data = t or b""
                kept, at, spans = [], 0, 0
                if lo:
                    zero = np.zeros(len(lo), np.int64)
                    for s, e in zip(*(x.tolist() for x in _spans(zero, zero, np.array(lo), np.array(hi))[2:])):
                        kept.append(data[at:s])
                        at, spans = e, spans + 1
                left = b"".join([*kept, data[at:]])
                row = (doc, len(data), len(data) - len(left), spans, left)
                for c, x in zip(out, row):
                    c.append(x)
            sha = [hashlib.sha256(x).hexdigest() for x in out[4]]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in out[:4]], pa.array(sha, pa.string()), pa.array(out[4], pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.mapInArrow(remove, schema).withColumnRenamed("id", doc_id)
