"""Exact join of documents by the Jaccard similarity of their word n-grams.

Documents with the same set of n-grams are one class. A pair of classes can only reach the
threshold if, whatever the order of all n-grams, the two share one among the first few of
each (its prefix). Several orders are used: the rarest-first one finds the candidates, and a
candidate must also share a prefix n-gram under each of the other orders before its sets are
counted. Before any set travels, a candidate must pass a bound from 512 bits of each set: the
parity of its n-grams in so many cells differs in no more cells than the sets have n-grams
that only one of them holds. Long sets fill these, so they have as many bits as n-grams besides,
by which the candidates are bounded once more.

Only connected groups are asked for, so a class is compared with its group's first class,
then with some other one whose component differs; pairs whose classes are not connected by
then are compared after that, every one. A prefix n-gram that may be frequent is dealt out
over several groups, whose first classes are then compared.

Texts are read for their classes, counts and parities, for prefixes, and, each time that pairs
are left to be counted, for the sets of these pairs' classes. n-grams are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from revsync.llm.common import components, extended, scoped, stage

#: n-grams are counted in 2**COUNTERS counters, whatever their number; these are sent to all
#: tasks. An n-gram's counter says how frequent it is at most.
COUNTERS, CHUNK = 20, 1 << 14
#: Classes in a group of a frequent n-gram, about.
GROUP = 5_000
#: Orders that a candidate must pass before its sets are counted, besides the first.
ORDERS = 2
#: Times that classes are compared with one other of their n-gram, before all pairs are.
MERGES = 1
#: log2 of the bits that say which classes' sets are wanted.
WANTED_BITS = 25
#: Bytes of text that are hashed together; words longer than LONG bytes are hashed alone.
BLOCK, LONG = 1 << 18, 64
#: 64-bit numbers that hold a set's parities, and n-grams from which a set has finer ones.
PARITIES, LONG_SET = 8, 256

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
     0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    np.uint64,
)


def _mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    """Another order of 64-bit numbers for every k."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[k]
    x = (x ^ (x >> np.uint64(29))) * _ODD[(k + 3) % 8]
    return x ^ (x >> np.uint64(32))


def _powers(of: int, n: int) -> np.ndarray:
    """1, of, of**2, ... modulo 2**64."""
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column's texts in one array of bytes, and where each begins and the last ends."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if off[0] == off[-1]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


class Sets:
    """Texts to sets of n-gram hashes.

    A word's hash is a polynomial of its bytes modulo 2**64, taken from running sums over a
    block of text, so that all words of a block are hashed at once.
    """

    BASE = 0x5851F42D4C957F2D

    def __init__(self, width: int):
        self.width = width
        values = _mix(np.arange(1, 257, dtype=np.uint64), 2)
        values[65:91] = values[97:123]
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        self.values, self.space = values, space
        self.up, self.down = (_powers(b, BLOCK) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))

    def __call__(self, column: pa.Array):
        """Each text's distinct hashes in ascending order; a text of fewer words is one n-gram."""
        data, off = _bytes(column)
        at = 0
        while at < len(off) - 1:
            # As many texts as a block holds, or one that is longer than that.
            to = max(int(np.searchsorted(off, off[at] + BLOCK, "right")) - 1, at + 1)
            yield from self._texts(data[off[at] : off[to]], off[at : to + 1] - off[at])
            at = to

    def _texts(self, data: np.ndarray, off: np.ndarray):
        if len(data) <= BLOCK:
            starts, words = self._words(data, off[:-1])
            ends = np.searchsorted(starts, off[1:])
        else:
            words = np.concatenate([self._words(piece, np.zeros(1, np.int64))[1] for piece in self._pieces(data)])
            ends = np.array([len(words)])
        n, width = len(words) - self.width + 1, self.width
        grams = np.zeros(max(n, 0), np.uint64)
        for k in range(width if n > 0 else 0):
            grams = _mix(grams, 5) + words[k : k + n] * _ODD[k % 8]
        grams, s = _mix(grams, 6), 0
        for e in ends.tolist():
            if e - s >= width:
                g = np.sort(grams[s : e - width + 1])
                new = g[1:] != g[:-1]
                yield g if new.all() else g[np.append(True, new)]
            elif e > s:
                yield np.array([xxhash.xxh64_intdigest(words[s:e].tobytes(), seed=e - s)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
            s = e

    def _pieces(self, data: np.ndarray):
        """A long text in pieces that end behind a space, of a block at most; a word that is
        longer than that is a piece."""
        at = 0
        while at < len(data):
            to = at + BLOCK
            if to < len(data):
                gaps = np.flatnonzero(self.space[data[at:to]])
                if len(gaps):
                    to = at + int(gaps[-1]) + 1
                else:
                    while to < len(data) and not (gap := self.space[data[to : to + BLOCK]]).any():
                        to += BLOCK
                    to = to + int(gap.argmax()) + 1 if to < len(data) else len(data)
            yield data[at:to]
            at = to

    def _words(self, data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words begin, and their hashes. No word reaches over one of `firsts`."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if len(data) > BLOCK:  # one word
            word = data.tobytes().lower().rstrip()
            return np.zeros(1, np.int64), np.array([xxhash.xxh64_intdigest(word)], np.uint64)
        space = self.space[data]
        apart = np.append(True, space[:-1])
        apart[firsts[firsts < len(data)]] = True
        starts = np.flatnonzero(~space & apart)
        apart = np.append(space[1:], True)
        apart[firsts[(firsts > 0) & (firsts <= len(data))] - 1] = True
        ends = np.flatnonzero(~space & apart) + 1
        sums = np.append(np.uint64(0), np.cumsum(self.values[data] * self.up[: len(data)], dtype=np.uint64))
        sizes = ends - starts
        words = _mix((sums[ends] - sums[starts]) * self.down[starts] + sizes.astype(np.uint64), 7)
        for w in np.flatnonzero(sizes > LONG):
            words[w] = xxhash.xxh64_intdigest(data[starts[w] : ends[w]].tobytes().lower())
        return starts, words


def _parities(grams: np.ndarray) -> np.ndarray:
    """Whether a set has an odd number of n-grams in each of 64 * PARITIES cells."""
    cells = _mix(grams, 3) % np.uint64(64 * PARITIES)
    odd = np.bincount(cells.astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _fine(grams: np.ndarray) -> bytes:
    """The same for as many cells as there are n-grams, or up to twice as many: a power of two,
    so that halves laid over each other give the parities of half the cells."""
    cells = 1 << (len(grams) - 1).bit_length()
    odd = np.bincount((_mix(grams, 3) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """The cells in which two sets' finer parities differ, by the fewer cells of the two."""
    x, y = sorted((np.frombuffer(b, np.uint8) for b in (x, y)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _key(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63)


def _prefix(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


class Counts:
    """How frequent n-grams are at most, by counters that several n-grams share."""

    def __init__(self, counters: np.ndarray):
        self.counters, self.usual = counters, int(counters.mean())

    @staticmethod
    def place(grams: np.ndarray) -> np.ndarray:
        return (_mix(grams, 4) >> np.uint64(64 - COUNTERS)).astype(np.int64)

    def prefix(self, grams: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n-grams of a set, rare ones first, and the groups to divide each into."""
        count = self.counters[self.place(grams)]
        at = np.lexsort((grams, count))[: _prefix(len(grams), percent)]
        return grams[at], self._groups(count[at])

    def groups(self, grams: np.ndarray) -> np.ndarray:
        return self._groups(self.counters[self.place(grams)])

    def _groups(self, count: np.ndarray) -> np.ndarray:
        return np.maximum(count - self.usual, 0) // GROUP + 1


#: Columns of a set's parities, and the value of a row without.
_PARITY, _NONE = [f"p{k}" for k in range(PARITIES)], np.zeros(PARITIES, np.int64)


def _classes(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Rows (id, cls, n, p0, ..., fine) of documents, the parities once per set and task, and
    (chunk, counts) of a task's counters, in which each of its sets counts once."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = (
        T.StructType([rows.schema["id"]]).add("cls", T.LongType()).add("n", T.LongType())
        .add("chunk", T.IntegerType()).add("counts", T.BinaryType())
    )
    for name in _PARITY:
        schema = schema.add(name, T.LongType())
    schema = schema.add("fine", T.BinaryType())

    def run(batches):
        sets, seen, counters = Sets(width), set(), np.zeros(1 << COUNTERS, np.int32)
        id_type = None
        for batch in batches:
            id_type, keys, ns, bits, fine = batch.schema.field(0).type, [], [], [], []
            for grams in sets(batch.column(1)):
                key = _key(grams) if len(grams) else None
                keys.append(key)
                ns.append(len(grams))
                first = key is not None and key not in seen
                if first:
                    seen.add(key)
                    counters[Counts.place(grams)] += 1  # of n-grams in one counter one counts
                bits.append(_parities(grams) if first else None)
                fine.append(_fine(grams) if first and len(grams) >= LONG_SET else None)
            n = len(ns)
            none = np.array([x is None for x in bits], bool)
            bits = np.array([_NONE if x is None else x for x in bits], np.int64).reshape(n, PARITIES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.int64()), pa.array(ns, pa.int64()),
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                 *(pa.array(np.ascontiguousarray(x), mask=none) for x in bits.T), pa.array(fine, pa.binary())],
                names=schema.names,
            )
        if seen:
            parts = [c.tobytes() for c in counters.reshape(-1, CHUNK)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                 pa.array(range(n), pa.int32()), pa.array(parts, pa.binary()),
                 *(pa.nulls(n, pa.int64()) for _ in _PARITY), pa.nulls(n, pa.binary())],
                names=schema.names,
            )

    return stage(rows.mapInArrow(run, schema), "jaccard-classes")


def _counters(classes: DataFrame) -> np.ndarray:
    """The tasks' counters added up, chunk by chunk as they pass by."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(counts, np.int32).astype(np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
            names=["chunk", "counts"],
        )

    rows = classes.where("chunk is not null").select("chunk", "counts").repartition("chunk")
    out = np.zeros((1 << COUNTERS) // CHUNK * CHUNK, np.int64).reshape(-1, CHUNK)
    for r in rows.mapInArrow(add, "chunk int, counts binary").collect():  # each chunk once
        out[r.chunk] = np.frombuffer(r.counts, np.int64)
    return out.reshape(-1)


def _postings(docs: DataFrame, text: str, width: int, percent: int, counters) -> DataFrame:
    """(gram, salt, cls, n_i): the classes' prefixes, once per task that has the class. `n_i`
    holds the set's size and the n-gram's place in its order, which are far below 2**31."""

    def run(batches):
        sets, seen, counts = Sets(width), set(), Counts(counters.value)
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for grams in sets(batch.column(0)):
                if not len(grams) or (key := _key(grams)) in seen:
                    continue
                seen.add(key)
                first, salts = counts.prefix(grams, percent)
                one = np.ones(len(first), np.int64)
                place = np.arange(len(first))
                row = (first.view(np.int64), key % salts, one * key, (one * len(grams) << 32) + place)
                for c, x in zip(cols, row):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in cols], names=["gram", "salt", "cls", "n_i"]
                )

    return docs.select(text).mapInArrow(run, "gram long, salt long, cls long, n_i long")


def _shared(postings: DataFrame, counters) -> DataFrame:
    """The postings of n-grams that several classes have, with each group's first class.

    Groups are runs in sorted rows and pass by one row after the other; none is held.
    """

    def run(batches):
        counts = Counts(counters.value)
        alone = None  # the run's first row, while no other has come
        key, was = None, None  # the last row's group and class
        head: tuple = (0, 0, 0)  # class, n and i of the run's first row
        for batch in batches:
            g, salt, cls, n_i = (np.asarray(batch.column(c)) for c in range(4))
            if not len(g):
                continue
            salts, n, i = counts.groups(g.view(np.uint64)), n_i >> 32, n_i & 0xFFFFFFFF
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (salt[1:] != salt[:-1])
            new[0] = key != (g[0], salt[0])
            again = np.zeros(len(g), bool)
            again[1:] = ~new[1:] & (cls[1:] == cls[:-1])
            again[0] = not new[0] and was == cls[0]
            at = np.maximum.accumulate(np.where(new, np.arange(len(g)), -1))
            lead = [np.where(at >= 0, x[at], h) for x, h in zip((cls, n, i), head)]
            member = ~new & ~again
            # The first row of a run with others; and of any, where an n-gram is divided.
            rows = member | (new & (salts > 1))
            rows[at[member & (at >= 0)]] = True
            cols = [x[rows] for x in (g, salts, cls, n, i, *lead)]
            if alone is not None and (member & (at < 0)).any():
                cols = [np.append(c, x) for c, x in zip(cols, alone)]
                alone = None
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)
            key, was, first = (g[-1], salt[-1]), cls[-1], at[-1]
            if first >= 0:
                head = (cls[first], n[first], i[first])
                alone = None if rows[first] else (g[first], salts[first], *head, *head)

    names = ["gram", "salts", "cls", "n", "i", "lead", "lead_n", "lead_i"]
    grouped = postings.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "cls")
    out = grouped.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return stage(out, "jaccard-shared")


def _pairs(df: DataFrame, percent: int) -> DataFrame:
    """(a, b, long), a below b, of the classes in x and y that may be similar, as often as they
    meet; `long` says that both have finer parities.

    The first n-gram that two sets share in their common order has no shared one before it:
    from there on either set must still have as many as the similarity asks for. Where that
    fails at the first, it fails at every later one.
    """
    need = (F.col("x.n") + F.col("y.n")) * percent
    enough = [(F.col(f"{s}.n") - F.col(f"{s}.i")) * (100 + percent) >= need for s in "xy"]
    return (
        df.where((F.col("x.cls") != F.col("y.cls")) & enough[0] & enough[1])
        .select(
            F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"),
            (F.least("x.n", "y.n") >= LONG_SET).alias("long"),
        )
    )


def _wanted(pairs: DataFrame) -> np.ndarray:
    """A bit for every hash of a class in `pairs`: 2**WANTED_BITS bits, whatever there is."""
    rows = (
        pairs.select(F.explode(F.array("a", "b")).alias("cls"))
        .select((F.pmod("cls", F.lit(1 << WANTED_BITS)) + 1).alias("h"))  # counted from 1
        .groupBy(F.bitmap_bucket_number("h").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
        .collect()
    )
    bits = np.zeros(1 << (WANTED_BITS - 3), np.uint8)
    for r in rows:
        part = np.frombuffer(r.bits, np.uint8)
        at = (r.bucket - 1) * len(part)
        bits[at : at + len(part)] = part
    return bits


def _sets(docs: DataFrame, text: str, width: int, pairs: DataFrame) -> DataFrame:
    """(cls, grams) of the classes in `pairs`, and of the few that share a bit with one."""
    wanted = docs.sparkSession.sparkContext.broadcast(_wanted(pairs))

    def run(batches):
        sets, seen, bits = Sets(width), set(), wanted.value
        for batch in batches:
            keys, grams = [], []
            for s in sets(batch.column(0)):
                if not len(s) or (key := _key(s)) in seen:
                    continue
                h = key % (1 << WANTED_BITS)
                if bits[h >> 3] >> (h & 7) & 1:
                    seen.add(key)
                    keys.append(key)
                    grams.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(grams, pa.binary())], names=["cls", "grams"]
            )

    rows = docs.select(text).mapInArrow(run, "cls long, grams binary")
    return stage(rows.groupBy("cls").agg(F.first("grams").alias("grams")), "jaccard-sets")


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether two sets' parities differ in no more cells than the similarity allows n-grams
    of one set only: these number at most (100 - percent) / (100 + percent) of both sizes."""
    differ = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in _PARITY), F.lit(0))
    return differ * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


def _bounded(pairs: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parities allow the similarity."""
    x, y = (parities.select(F.col("cls").alias(s), F.struct("n", *_PARITY).alias(t)) for s, t in ("ax", "by"))
    return pairs.join(x, "a").join(y, "b").where(_alike("x", "y", percent)).select("a", "b", "long")


def _refined(pairs: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """The pairs whose finer parities allow the similarity; a pair of which one has none stays."""

    def run(batches):
        for batch in batches:
            n, x, y = (batch.column(c).to_pylist() for c in (2, 3, 4))
            keep = [_differ(b, c) * (100 + percent) <= of * (100 - percent) for of, b, c in zip(n, x, y)]
            pair = [batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays(pair, names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # A pair's two rows meet by its key, so only parities that a pair asks for are shuffled.
    ends = pairs.where("long").select("a", "b", F.explode(F.array("a", "b")).alias("cls"))
    sides = parities.where("fine is not null").select("cls", "n", "fine").join(ends, "cls").groupBy("a", "b")
    both = sides.agg(F.sum("n").alias("n"), F.min("fine").alias("x"), F.max("fine").alias("y"))
    return pairs.where("not long").select("a", "b").unionAll(both.mapInArrow(run, "a long, b long"))


def _verified(
    pairs: DataFrame, parities: DataFrame, docs: DataFrame, text: str, width: int, percent: int
) -> DataFrame:
    """The pairs that pass every order's prefix filter and whose similarity is reached."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(g.as_buffer(), np.uint64) for g in (x, y))
                keep.append(_similar(x, y, percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(mask)

    with scoped(docs.sparkSession) as keep:
        pairs = stage(_refined(pairs, parities, percent), "jaccard-refined")
        if pairs.isEmpty():
            return keep(pairs, "jaccard-links")
        sets = _sets(docs, text, width, pairs)
        with_b = pairs.join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("y")), "b")
        both = with_b.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("x")), "a")
        return keep(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "jaccard-links")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    for k in range(1, ORDERS + 1):
        p, q = (_first(s, percent, k) for s in (a, b))
        if not len(np.intersect1d(p, q, assume_unique=True)):
            return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _first(grams: np.ndarray, percent: int, order: int) -> np.ndarray:
    p = _prefix(len(grams), percent)
    return grams[np.argpartition(_mix(grams, order), p - 1)[:p]]


def _open(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `shared`, with their component, of n-grams whose classes have several."""
    with scoped(shared.sparkSession) as keep:
        placed = stage(
            shared.select("gram", "cls", "n", "i")  # an n-gram has a class once
            .join(found, F.col("cls") == F.col("node"), "left")
            .select("gram", "cls", "n", "i", F.coalesce("component", "cls").alias("comp")),
            "jaccard-placed",
        )
        several = placed.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        several = stage(several.where("lo <> hi").select("gram"), "jaccard-open")
        return keep(placed.join(several, "gram", "left_semi"), "jaccard-left")


def join(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 75,
) -> DataFrame:
    """Per row of `docs`: its id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a document's
    set holds its distinct runs of `width` words, or all of fewer words as one. Two link
    when 100 * intersection >= `percent` * union; component_id is the smallest id that links
    reach. Null and empty texts have no set and link with nothing; their component is their
    own id. Equal sets link, so repeated rows share a component; a null id is passed over in
    looking for the smallest, and a component of null ids only has a null component_id.
    """
    with scoped(docs.sparkSession) as keep:
        return keep(_joined(docs, doc_id, text, width, percent), "jaccard")


def _joined(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    classes = _classes(docs, doc_id, text, width)
    counters = sc.broadcast(_counters(classes))
    shared = _shared(_postings(docs, text, width, percent, counters), counters)

    # Every class against the first of its groups, and these among themselves.
    parities = classes.where("p0 is not null").groupBy("cls", "n")
    parities = stage(parities.agg(*(F.first(p).alias(p) for p in [*_PARITY, "fine"])), "jaccard-parities")
    me = F.struct("cls", "n", "i")
    lead = F.struct(F.col("lead").alias("cls"), F.col("lead_n").alias("n"), F.col("lead_i").alias("i"))
    split = shared.where("salts > 1").groupBy("gram").agg(F.min(lead).alias("y"))
    across = shared.where("salts > 1 and cls = lead").join(split, "gram")
    stars = _pairs(shared.select(me.alias("x"), lead.alias("y")), percent).unionAll(
        _pairs(across.select(me.alias("x"), "y"), percent)
    )
    stars = stage(_bounded(stars.distinct(), parities, percent), "jaccard-stars")
    links = _verified(stars, parities, docs, text, width, percent)

    tried, found = stars, components(links, "a", "b")

    # Then against some other class of the n-gram, where their components differ. Components
    # only grow, so an n-gram whose classes have one needs not be looked at again.
    left = shared
    for k in range(MERGES):
        left = _open(left, found)
        other = F.max_by(F.struct("cls", "n", "i", "comp"), F.xxhash64("cls", "gram", F.lit(k)))
        other = stage(left.groupBy("gram").agg(other.alias("y")), "jaccard-others")
        apart = left.join(other, "gram").where("comp <> y.comp").select(me.alias("x"), "y")
        pairs = _bounded(_pairs(apart, percent).distinct(), parities, percent)
        pairs = stage(pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-merges")
        if pairs.isEmpty():
            break
        links = _verified(pairs, parities, docs, text, width, percent)
        tried, found = tried.unionAll(pairs), extended(found, links, "a", "b")

    # What is not connected by then: every pair of an n-gram whose components differ.
    left = stage(_open(left, found).join(parities.drop("n", "fine"), "cls"), "jaccard-parted")
    me = F.struct("cls", "n", "i", *_PARITY)
    x, y = (left.select("gram", F.col("comp").alias(f"{s}c"), me.alias(s)) for s in "xy")
    rest = _pairs(x.join(y, "gram").where("xc < yc").where(_alike("x", "y", percent)), percent)
    rest = stage(rest.distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-rest")
    if not rest.isEmpty():
        links = _verified(rest, parities, docs, text, width, percent)
        if not links.isEmpty():
            found = extended(found, links, "a", "b")

    rows = classes.where("n is not null").select("id", "cls", "n")
    rows = rows.join(found, F.col("cls") == F.col("node"), "left").select(
        "id", "n", F.coalesce("component", "cls").alias("comp")
    )
    rows = stage(rows, "jaccard-rows")
    smallest = stage(
        rows.where("comp is not null").groupBy("comp").agg(F.min("id").alias("smallest")), "jaccard-smallest"
    )
    return rows.join(smallest, "comp", "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("smallest")).alias("component_id"),
    )
