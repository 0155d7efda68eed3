"""Language identification by bit-sliced Bloom filters over byte n-grams.

An array of language bitmasks stands for a Bloom filter per language: bit l of a cell is
cell's bit in language l's filter. A cell has as many 64-bit words as the languages need. An n-gram's masks at its hash positions, ANDed, give all
languages that may contain it in as many look-ups as one filter needs. A text's count of
n-grams per language, less what the filter's fill lets through by chance, decides.

An n-gram enters a language's filter if it is frequent there; the filters are fitted on a
bounded sample of labelled rows, every text is judged whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from revsync.llm.common import stage

#: n-grams are of GRAM bytes; the filters have 2**BITS cells and HASHES positions per n-gram.
GRAM, BITS, HASHES = 5, 20, 2
#: Labelled rows of a language that the filters are fitted on, about.
SAMPLE = 4_000
#: Occurrences per million n-grams that let an n-gram into a language's filter.
RATE = 4.0
#: Bytes of text that are hashed at once; a longer text is taken in pieces that overlap.
BLOCK = 1 << 20
UNDETERMINED = "und"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def _fold() -> np.ndarray:
    """What a byte counts as: letters by case, all that isn't one as a space."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    for a in range(26):
        t[65 + a] = t[97 + a] = 97 + a
    return t


_FOLDED = _fold().tobytes()


def _grams(text: str) -> np.ndarray:
    """The codes of a text's n-grams, spaces run together and one at either end."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLDED).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(b) < GRAM:
        return np.zeros(0, np.uint64)
    code = b[: len(b) - GRAM + 1].copy()
    for k in range(1, GRAM):
        code |= b[k : len(b) - GRAM + 1 + k] << np.uint64(8 * k)
    return code


def _cells(code: np.ndarray, k: int) -> np.ndarray:
    return ((code * _ODD[k]) >> np.uint64(64 - BITS)).astype(np.int64)


def letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Filters:
    """Languages, their cells' masks and how full each one's filter is."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks  # a row of cells for each 64 languages
        bits = [((masks[i >> 6] >> np.uint64(i & 63)) & np.uint64(1)).mean() for i in range(len(languages))]
        self.chance = np.array(bits, float) ** HASHES  # that an n-gram gets through by accident

    def judge(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not letters(text):
            return UNDETERMINED, 0.0
        n, hits = 0, np.zeros(len(self.languages))
        for at in range(0, len(text), BLOCK):
            code = _grams(text[at : at + BLOCK + GRAM])
            cells = [_cells(code, k) for k in range(HASHES)]
            n += len(code)
            for w, masks in enumerate(self.masks):
                mask = masks[cells[0]]
                for c in cells[1:]:
                    mask &= masks[c]
                of = range(64 * w, min(64 * w + 64, len(hits)))
                hits[64 * w : 64 * w + 64] += [np.count_nonzero(mask & np.uint64(1 << (i & 63))) for i in of]
        if not n:
            return self.languages[0], 0.0
        true = np.clip((hits - self.chance * n) / (1 - np.minimum(self.chance, 0.99)), 0, None)
        best = int(np.argmax(true))  # of equals the first, in the languages' order
        total = float(true.sum())
        return self.languages[best], float(true[best] / total) if total > 0 else 0.0


def fit(docs: DataFrame, text: str, lang: str, key: Column, sample: int = SAMPLE) -> Filters:
    """Fit the filters on about `sample` rows of each language, those of the smallest hash.

    Where there are more rows than that, the share of the hash's range is narrowed so that
    `sample` are expected.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n"))
    sizes = sizes.collect()
    languages = sorted(r.l for r in sizes)
    if not languages:
        return Filters([], np.zeros((0, 1 << BITS), np.uint64))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.l, min(1.0, sample / r.n))])
    rows = labelled.select(
        F.col(text).alias("text"), F.col(lang).alias("lang"),
        (F.pmod(F.xxhash64(key, F.lit("language")), F.lit(1 << 30)) / float(1 << 30)).alias("u"),
    )
    wanted = F.col("u") < share[F.col("lang")]
    number = {name: i for i, name in enumerate(languages)}

    def count(batches):
        """Per language and n-gram the occurrences, where a task has some."""
        seen: dict[int, dict[int, int]] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, n = np.unique(_grams(t), return_counts=True)
                mine = seen.setdefault(number[name], {})
                for c, k in zip(codes.astype(np.int64).tolist(), n.tolist()):
                    mine[c] = mine.get(c, 0) + k
        for i, mine in seen.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(mine), i, np.int32)),
                    pa.array(np.fromiter(mine.keys(), np.int64, len(mine))),
                    pa.array(np.fromiter(mine.values(), np.int64, len(mine))),
                ],
                names=["language", "code", "n"],
            )

    counts = (
        rows.where(wanted).select("text", "lang")
        .mapInArrow(count, "language int, code long, n long")
        .groupBy("language", "code").agg(F.sum("n").alias("n"))
    )
    counts = stage(counts, "language-grams")
    total = counts.groupBy("language").agg(F.sum("n").alias("total"))

    def cells(batches):
        for batch in batches:
            code = np.asarray(batch.column(1)).astype(np.uint64)
            language = np.asarray(batch.column(0)).astype(np.uint64)
            word, bit = language >> np.uint64(6), np.uint64(1) << (language & np.uint64(63))
            for k in range(HASHES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.astype(np.int32)), pa.array(_cells(code, k)), pa.array(bit.astype(np.int64))],
                    names=["word", "cell", "bit"],
                )

    masks = np.zeros((-(-len(languages) // 64), 1 << BITS), np.uint64)
    set_cells = (
        counts.join(total, "language")
        .where((F.col("n") > 1) & (F.col("n") * 1e6 >= F.col("total") * RATE))
        .select("language", "code")
        .mapInArrow(cells, "word int, cell long, bit long")
        .groupBy("word", "cell").agg(F.bit_or("bit").alias("mask"))
    )
    got = set_cells.toPandas()  # at most 2**BITS rows for each 64 languages
    masks[got["word"].to_numpy(), got["cell"].to_numpy()] = got["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return Filters(languages, masks)


def identify(
    docs: DataFrame,
    filters: Filters,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Per row of `docs`: its id, the columns in `keep`, lang_pred and score.

    A text that is null or has no letter is `und` with score 0, and so is every text if no
    labelled row was there to learn from. Only the text is looked at. Repeated rows and
    null ids give rows like others; of equal languages the first in order wins.
    """
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.masks))
    names = [doc_id, *(keep or [])]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(text).alias("t"))
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)]

    def run(batches):
        judge = Filters(*shared.value).judge
        for batch in batches:
            got = [judge(t) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(len(names))],
                    pa.array([x for x, _ in got], pa.string()),
                    pa.array([x for _, x in got], pa.float64()),
                ],
                names=[f.name for f in fields] + ["lang_pred", "score"],
            )

    out = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    judged = rows.mapInArrow(run, T.StructType([*fields, *out]))
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "lang_pred", "score")
