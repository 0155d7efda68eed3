"""Byte-level BPE by a segment tree: texts to token ids, and ids back to bytes.

A text is cut into pieces by the vocabulary's pattern, and every piece is encoded on its
own. Over the byte positions of a piece stands a segment tree. The leaf of position i holds
the rank of the pair of live parts of which the first starts at i, and each inner node the
least (rank, position) below it, so the root names the leftmost pair of least rank. A merge
ends one part and changes three leaves: that of the pair itself, of its right part, which is
no more, and of its live left neighbour; each change climbs at most to the root. A piece of
n bytes so takes O(n log n) steps, however long it is.

The trees of many short pieces stand side by side in arrays and take their merges in step.
Pieces recur, so a worker keeps the ids of those it has met, in tables of bounded size.
Texts stay where they are: nothing is shuffled.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Entries of each of a worker's two tables of pieces.
CACHE = 250_000
#: Characters whose pieces are looked up at once; pieces whose trees stand side by side.
CHUNK, SIDE_BY_SIDE = 2_000_000, 32_768
#: Bytes of a piece from which it gets a tree of its own, and its ids are not kept.
LONG = 64
#: No pair, or one that the ranks do not have.
NONE = 2**62
#: A character of each class of a pattern, to stand for one that the tables class otherwise.
STAND_INS = {"letter": "ß", "number": "²", "other": "§", "space": " "}


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: per line a token in base64, and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece. A piece that is a token itself is that token."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    shift, rank_of = size.bit_length(), ranks.get
    low = (1 << shift) - 1
    tree = array("q", [NONE]) * (2 * size)
    for i in range(n - 1):
        if (r := rank_of(piece[i : i + 2])) is not None:
            tree[size + i] = r << shift | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = array("q", range(1, n + 1))  # of the part that starts here
    left = array("q", range(-1, n))  # start of the part that ends here
    while (least := tree[1]) != NONE:
        i = least & low
        j = end[i]
        e = end[j]
        end[i], left[e] = e, i
        changes = [(j, NONE), (i, NONE)]
        if e < n and (r := rank_of(piece[i : end[e]])) is not None:
            changes[1] = (i, r << shift | i)
        if i:
            p = left[i]
            r = rank_of(piece[p:e])
            changes.append((p, NONE if r is None else r << shift | p))
        for at, value in changes:
            k = size + at
            tree[k] = value
            while k > 1:
                a, b = tree[k], tree[k ^ 1]
                if b < a:
                    a = b
                k >>= 1
                if tree[k] == a:
                    break
                tree[k] = a
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Pairs:
    """The ranks by pairs of ids, to look up many at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.width = ranks, max(ranks.values(), default=0) + 1
        found = {}
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    found[a * self.width + b] = r
        self.keys = np.array(sorted(found) or [-1], np.int64)
        self.values = np.array([found[k] for k in sorted(found)] or [NONE], np.int64)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair joined, or -1."""
        wanted = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], -1)


def merge_many(pieces: list[bytes], size: int, pairs: Pairs) -> list[bytes]:
    """`merge` for pieces of 2 to `size` bytes, a power of 2; ids as 32-bit integers.

    Row r of each array is piece r's. All trees take one merge per round, until the root of
    each says that nothing is left.
    """
    m, shift = len(pieces), size.bit_length()
    n = np.fromiter(map(len, pieces), np.int64, m)
    text = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
    at = np.arange(size)
    live = at < n[:, None]
    ids = np.zeros((m, size + 1), np.int64)
    ids[:, :size] = pairs.byte[text]
    tree = np.full((m, 2 * size), NONE, np.int64)
    r = pairs(ids[:, : size - 1], ids[:, 1:size])
    tree[:, size : 2 * size - 1] = np.where(live[:, 1:] & (r >= 0), r << shift | at[:-1], NONE)
    for k in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    end, left = np.empty((m, size + 1), np.int64), np.empty((m, size + 2), np.int64)
    end[:], left[:] = np.arange(1, size + 2), np.arange(-1, size + 1)
    rows = np.arange(m)

    def put(leaf, value):
        k = size + leaf
        tree[rows, k] = value
        while size > 1 and k[0] > 1:
            value = np.minimum(value, tree[rows, k ^ 1])
            k = k >> 1
            tree[rows, k] = value

    while len(rows := rows[tree[rows, 1] != NONE]):
        least = tree[rows, 1]
        i, r = least & ((1 << shift) - 1), least >> shift
        j = end[rows, i]
        e, p = end[rows, j], left[rows, i]
        ids[rows, i], end[rows, i], left[rows, e], live[rows, j] = r, e, i, False
        after = pairs(r, ids[rows, e])
        before = pairs(ids[rows, p], r)
        put(j, np.full(len(rows), NONE))
        put(i, after := np.where((e < n[rows]) & (after >= 0), after << shift | i, NONE))
        first = p < 0
        put(np.where(first, i, p), np.where(first, after, np.where(before >= 0, before << shift | p, NONE)))
    flat, ends = ids[:, :size][live].astype("<i4").tobytes(), np.cumsum(live.sum(1) * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Pieces:
    """Ids of pieces as 32-bit integers; what is not known is encoded, and kept for a while."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.young, self.old = {}, {}

    def __call__(self, found: set[str]) -> dict[str, bytes]:
        """A table that has all of `found`, to be used at once."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        table, more, by_size = self.young, {}, {}
        for piece in found - table.keys():
            if (ids := self.old.get(piece)) is not None:
                table[piece] = ids
                continue
            text = piece.encode()
            if text in self.ranks:
                table[piece] = array("i", [self.ranks[text]]).tobytes()
            elif len(text) > LONG:
                more[piece] = array("i", merge(text, self.ranks)).tobytes()
            else:
                by_size.setdefault(1 << (len(text) - 1).bit_length(), []).append((piece, text))
        for size, some in by_size.items():
            for k in range(0, len(some), SIDE_BY_SIDE):
                names, texts = zip(*some[k : k + SIDE_BY_SIDE])
                table.update(zip(names, merge_many(texts, size, self.pairs)))
        return table | more if more else table


class Cutter:
    """A text's pieces by the pattern, with characters classed as the encoder's library has them.

    That library and the one used here follow different versions of Unicode. Every character
    not met before is looked up in both; one on which they differ is replaced by a stand-in
    of the encoder's class while its text is cut.
    """

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        self.find = regex.compile(pattern).findall
        self.known, self.odd = set(map(chr, range(128))), {}
        single = {bytes([b]): b for b in range(256)}
        self.probes = []
        for kind, first in (("letter", "a"), ("number", "1"), ("other", "!"), ("space", "\t")):
            pairs = {first.encode() + bytes([b]): 256 + b for b in range(256)}
            joined = tiktoken.Encoding(kind, pat_str=pattern, mergeable_ranks=single | pairs, special_tokens={})
            self.probes.append((kind, first, joined.encode_ordinary))

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text)
        chars = set(text)
        for c in chars - self.known:
            self.learn(c)
        if not self.odd or self.odd.keys().isdisjoint(map(ord, chars)):
            return self.find(text)
        ends = list(accumulate(map(len, self.find(text.translate(self.odd)))))
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, c: str) -> None:
        self.known.add(c)
        there = next((k for k, first, ids in self.probes if ids(first + c)[0] >= 256), None)
        here = next((k for k, first, _ in self.probes if len(self.find(first + c)) == 1), None)
        if there != here and there is not None:
            self.odd[ord(c)] = STAND_INS[there]


def chunks(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in order, so many at a time that they have CHUNK characters or are one; null is empty."""
    some, n = [], 0
    for t in texts:
        some.append(t.as_py() or "")
        n += len(some[-1])
        if n >= CHUNK:
            yield some
            some, n = [], 0
    if some:
        yield some


def encode(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row of `docs`: its id, and `ids`, an array of the text's token ids.

    `ranks` is the path of a rank file, read on the driver and sent to the tasks; its size is
    that of the vocabulary. A null or empty text has no ids. Every row gives a row, repeated
    ids and null ids included; other columns are left out. There are no special tokens:
    their strings are ordinary text.
    """
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks), {}))

    def run(batches):
        ranks, kept = shared.value  # one per worker: the tables outlive a task
        if not kept:
            kept.update(cut=Cutter(pattern), pieces=Pieces(ranks))
        cut, pieces = kept["cut"], kept["pieces"]
        for batch in batches:
            found, ends = [], [0]
            for texts in chunks(batch.column(1)):
                cuts = [cut(t) for t in texts]
                ids_of = pieces(set().union(*cuts)).__getitem__
                for c in cuts:
                    found.append(b"".join(map(ids_of, c)))
                    ends.append(ends[-1] + len(found[-1]) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(found))])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", doc_id)


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its token ids in `into`, in place of `ids`; null for null.

    The bytes of any ids need not be UTF-8, so they are left as bytes. An id that the rank
    file does not have is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast({r: t for t, r in read_ranks(ranks).items()})
    others = [c for c in encoded.columns if c != ids]

    def run(batches):
        token = shared.value.__getitem__
        for batch in batches:
            column = batch.column(len(others))
            starts, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            whole = column.is_valid().to_pylist()
            out = [
                b"".join(map(token, values[a:b].tolist())) if ok else None
                for ok, a, b in zip(whole, starts[:-1], starts[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "bytes"]
            )

    rows = encoded.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(others)), F.col(ids).alias("ids"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("bytes", T.BinaryType())])
    done = rows.mapInArrow(run, schema)
    return done.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(others)), F.col("bytes").alias(into))


def ids_digest(ids: str) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")).cast("binary"), 256)


def round_trip(
    docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of `docs`: its id, n_tokens, and digests of the ids and of the decoded bytes."""
    ids = encode(docs, ranks, pattern, doc_id, text).select(
        F.col(doc_id), F.size("ids").cast("long").alias("n_tokens"), ids_digest("ids").alias("ids_sha256"), "ids"
    )
    return decode(ids, ranks).select(
        doc_id, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
