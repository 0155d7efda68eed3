"""Token counts by a two-tier lookup, without moving any pre-token.

A byte-level BPE splits a text into pre-tokens by a pattern and encodes each on its own, so
a text's count is the sum of its pre-tokens' counts. Tier one is a table of the corpus's
frequent pre-tokens with their counts, of bounded size and sent to every task; tier two is a
cache per worker that encodes each other pre-token when first met.

The frequent ones are found over all texts: every task counts its own pre-tokens in a
summary of bounded size and hands on the heaviest few. Which ones make it into the table
changes the time only, never a count.
"""

from __future__ import annotations

import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Entries of the table that is broadcast; a pre-token in it has at most LONGEST characters.
TABLE, LONGEST = 32_768, 24
#: Pre-tokens that a task counts at once, and those that it hands on.
SUMMARY, HANDED_ON = 200_000, 4_096
#: Entries of a worker's cache before it starts anew.
CACHE = 400_000


class Cutter:
    """A tokenizer's pre-tokens: its special strings, and the pattern's pieces between them."""

    def __init__(self, spec: str, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.special = [x["content"] for x in json.loads(spec)["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)").split

    def __call__(self, text: str) -> tuple[list[str], int]:
        """Its pre-tokens, and how many special strings stand between them."""
        if not any(s in text for s in self.special):
            return self.find(text), 0
        parts = self.split(text)
        return [x for p in parts for x in self.find(p)], len(parts) - 1


class Lengths(dict):
    """Pre-token to its number of tokens; what is not known is encoded, and kept for a while."""

    def __init__(self, spec: str, known: dict[str, int]):
        from tokenizers import Tokenizer

        super().__init__(known)
        self.known, self.tokenizer = known, Tokenizer.from_str(spec)

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 4 * LONGEST:
            if len(self) > len(self.known) + CACHE:
                self.clear()
                self.update(self.known)
            self[piece] = n
        return n


def frequent(docs: DataFrame, text: str, spec: str, pattern: str, size: int) -> dict[str, int]:
    """The `size` heaviest pre-tokens of all texts, by the tasks' summaries, with their counts."""

    def count(batches):
        cut, seen = Cutter(spec, pattern), Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(cut(t or "")[0])
                if len(seen) > SUMMARY:
                    seen = Counter(dict(seen.most_common(SUMMARY // 2)))
        top = [(p, n) for p, n in seen.most_common(HANDED_ON) if n > 1 and len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
            names=["piece", "n"],
        )

    top = (
        docs.select(text)
        .mapInArrow(count, "piece string, n long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(size)
        .collect()
    )
    lengths = Lengths(spec, {})
    return {r.piece: lengths[r.piece] for r in top}


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = 512,
    size: int = TABLE,
) -> DataFrame:
    """Per row of `docs`: its id, n_bytes, n_tokens and over_limit.

    `tokenizer` is the path of a byte-level BPE's file, read on the driver and sent to the
    tasks; `pattern` is the pattern by which it cuts pre-tokens. Null and empty texts count
    0. Every row gives a row, repeated ids and null ids included; other columns are left
    out. Special strings within a text are the special token, as the library has it.
    """
    sc = docs.sparkSession.sparkContext
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    shared = sc.broadcast((spec, frequent(docs, text, spec, pattern, size)))

    def run(batches):
        spec, known = shared.value
        cut, lengths = Cutter(spec, pattern), Lengths(spec, known)
        for batch in batches:
            n = []
            for t in batch.column(1).to_pylist():
                pieces, special = cut(t or "")
                n.append(special + sum(map(lengths.__getitem__, pieces)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), n_bytes)
    schema = T.StructType(
        [rows.schema["doc_id"], rows.schema["n_bytes"], T.StructField("n_tokens", T.LongType())]
    )
    counted = rows.mapInArrow(run, schema)
    return counted.select(
        F.col("doc_id").alias(doc_id), "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
