"""Personal data by fixed patterns, and by a skip-chain conditional random field on top.

Patterns find e-mail addresses, IP addresses, card and phone numbers that are written in
full. The field labels the other tokens that hold a digit or an @: neighbours in the text
share a chain potential, and each recurrence of a token, or of its digits, shares a skip
potential with the one before it, however far apart they stand. Loopy message passing then
carries a label from where it is certain to the places where the same thing is written in
part. What patterns have found stays as it is.

The field is trained here: its labels are the patterns' own finds on a bounded sample of
documents, its token features are coarse shapes, its pair potentials how often labels meet.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["other", *KINDS]
#: Documents that the field is trained on, about; their texts are read whole.
SAMPLE = 20_000
#: The probability from which a token is taken for its label; the change of a message that
#: counts as none; rounds after which messages move less with each one, so that all settle.
CERTAIN, SETTLED, ROUNDS = 0.9, 1e-3, 12
#: How strongly a pattern's find holds its tokens to its label, in log odds.
HOLD = 8.0

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never ends within a run of digits, so none that counts begins within one.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s]*[0-9@][^\s]*")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost addresses. An address begins where the run before its @ does, so every @ is
    looked at once, and a long run without one costs nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), 0
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of what the patterns find, by start, then kind."""
    found = list(emails(text))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m[0])) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


#: What a token is described by; every feature is there or not.
FEATURES = [
    "at", "dot after at", "1-2 digits", "3-5 digits", "6-9 digits", "10-13 digits",
    "14-19 digits", "more digits", "1 dot", "2 dots", "3 dots", "more dots", "plus", "hyphen",
    "bracket", "letter", "luhn", "octets", "neighbour with plus", "neighbour in brackets",
    "neighbour with 6-9 digits", "all but digits",
]


def _shape(token: str) -> int:
    t = token.strip(".,;:!?\"'")
    digits = _NOT_DIGIT.sub("", t)
    n, dots, at = len(digits), t.count("."), t.find("@")
    on = {
        0: at >= 0, 1: at >= 0 and "." in t[at:], 2: 1 <= n <= 2, 3: 3 <= n <= 5, 4: 6 <= n <= 9,
        5: 10 <= n <= 13, 6: 14 <= n <= 19, 7: n > 19, 8: dots == 1, 9: dots == 2, 10: dots == 3,
        11: dots > 3, 12: t.startswith("+"), 13: "-" in t, 14: "(" in t or ")" in t,
        15: any(map(str.isalpha, t[:200])), 16: 14 <= n <= 19 and luhn(digits),
        17: dots == 3 and all(p.isdecimal() and len(p) < 4 and int(p) < 256 for p in t.split(".")),
        21: n == 0,
    }
    return sum(1 << i for i, x in on.items() if x)


class Graph:
    """The tokens of some documents as nodes, with chain and skip edges."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.shapes: list[int] = []
        self.labels: list[int] = []  # by the patterns' finds; 0 where there is none
        self.edges: list[tuple[int, int, int]] = []  # node, node, 0 chain or 1 skip
        self.sizes: list[int] = []  # edges of each text

    def add(self, text: str, base: list[tuple[int, int, int]]) -> range:
        first, last, edges = len(self.spans), None, len(self.edges)
        met: dict[str, int] = {}
        at = 0
        for m in _TOKEN.finditer(text):
            i = len(self.spans)
            start, end = m.span()
            while at < len(base) and base[at][1] <= start:
                at += 1
            label = next((k + 1 for s, e, k in base[at : at + 4] if s < end and e > start), 0)
            self.spans.append((start, end))
            self.shapes.append(_shape(m[0]))
            self.labels.append(label)
            if last is not None and start - self.spans[last][1] <= 2:
                self.edges.append((last, i, 0))
                for a, b in ((last, i), (i, last)):
                    x = self.shapes[b]
                    self.shapes[a] |= (
                        (x >> 12 & 1) << 18 | (x >> 14 & 1) << 19 | (x >> 4 & 1) << 20
                    )
            last = i
            word = m[0].strip(".,;:!?\"'()").lower()
            digits = _NOT_DIGIT.sub("", word)
            for key in {word, digits if len(digits) >= 6 else word}:
                if key in met and met[key] != i:
                    self.edges.append((met[key], i, 1))
                met[key] = i
        self.sizes.append(len(self.edges) - edges)
        return range(first, len(self.spans))


class Field:
    """Weights of the features, one column a label, and the pair potentials by kind of edge."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def unary(self, shapes) -> np.ndarray:
        bits = np.asarray(shapes, np.int64)[:, None] >> np.arange(len(FEATURES)) & 1
        x = np.hstack([bits, np.ones((len(bits), 1))])
        return x @ self.weights

    def marginals(self, g: Graph) -> np.ndarray:
        """Label probabilities of every node after message passing in log space.

        Each text's messages are passed until they settle, whatever other texts do.
        """
        own = self.unary(g.shapes)
        labels = np.asarray(g.labels)
        held = np.flatnonzero(labels)
        own[held, labels[held]] += HOLD
        belief = own.copy()
        if g.edges:
            a, b, kind = np.asarray(g.edges).T
            src, dst, both = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([kind, kind])
            text = np.tile(np.repeat(np.arange(len(g.sizes)), g.sizes), 2)
            msg, each = np.zeros((len(src), len(LABELS))), np.arange(len(LABELS))
            # Messages of texts that have not settled, forth and back in two halves.
            live, step = np.arange(len(src)), 0.5
            for k in itertools.count(1):
                half = len(live) // 2
                back = np.concatenate([live[half:], live[:half]])
                out = (belief[src[live]] - msg[back])[:, :, None] + self.pairs[both[live]]
                top = out.max(axis=1, keepdims=True)
                new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                change = step * (new - new.max(axis=1, keepdims=True) - msg[live])
                msg[live] += change
                # What reaches a node is summed anew each time, in the order of the edges.
                nodes = dst[live]
                belief[nodes] = own[nodes]
                np.add.at(belief.reshape(-1), (nodes[:, None] * len(LABELS) + each).reshape(-1), msg[live].reshape(-1))
                most = np.zeros(len(g.sizes))
                np.maximum.at(most, text[live], np.abs(change).max(axis=1))
                live = live[most[text[live]] >= SETTLED]
                if not len(live):
                    break
                if k >= ROUNDS:
                    step *= 0.7
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, texts: list[str | None]) -> list[tuple[list, list]]:
        """Of every text the patterns' spans and all spans, each by start, then kind."""
        g, where = Graph(), []
        for t in texts:
            base = base_spans(t) if t and _ANY.search(t) else []
            where.append((base, g.add(t, base) if t and _ANY.search(t) else range(0)))
        p = self.marginals(g) if g.spans else np.zeros((0, len(LABELS)))
        best, sure = p.argmax(axis=1), p.max(axis=1) >= CERTAIN if len(p) else []
        out = []
        for t, (base, nodes) in zip(texts, where):
            more: list[tuple[int, int, int]] = []
            for i in nodes:
                if g.labels[i] or not best[i] or not sure[i]:
                    continue
                start, end = g.spans[i]
                while end > start + 1 and t[end - 1] in ".,;:!?\"'":
                    end -= 1
                k = int(best[i]) - 1
                if more and more[-1][2] == k and not t[more[-1][1] : start].strip() and start - more[-1][1] <= 2:
                    more[-1] = (more[-1][0], end, k)
                else:
                    more.append((start, end, k))
            out.append((base, sorted(base + more, key=lambda s: (s[0], s[2])) if more else base))
        return out


def train(docs: DataFrame, doc_id: str, text: str, sample: int = SAMPLE) -> Field:
    """A field trained on about `sample` documents, those whose id has the smallest hash."""
    n = docs.count()
    u = F.pmod(F.xxhash64(F.col(doc_id), F.lit("pii")), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.where(u < min(1.0, sample / max(n, 1))).select(text)

    def count(batches):
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t or not _ANY.search(t):
                    continue
                g = Graph()
                g.add(t, base_spans(t))
                met = [(-1, x << 8 | y) for x, y in zip(g.shapes, g.labels)]
                met += [(k, g.labels[a] << 8 | g.labels[b]) for a, b, k in g.edges]
                for x in met:
                    seen[x] = seen.get(x, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in seen], pa.int32()),
                pa.array([x for _, x in seen], pa.int64()),
                pa.array(list(seen.values()), pa.int64()),
            ],
            names=["kind", "what", "n"],
        )

    got = rows.mapInArrow(count, "kind int, what long, n long").groupBy("kind", "what")
    return _fit([tuple(r) for r in got.agg(F.sum("n").alias("n")).collect()])


def _fit(counts: list[tuple[int, int, int]]) -> Field:
    """Weights by gradient ascent on the weighted likelihood; pairs as pointwise information."""
    k = len(LABELS)
    nodes = sorted((what >> 8, what & 255, n) for kind, what, n in counts if kind < 0)
    weights = np.zeros((len(FEATURES) + 1, k))
    weights[-1, 0] = 4.0  # without anything to learn from, all is other
    if nodes:
        shapes, labels, n = (np.asarray(c) for c in zip(*nodes))
        x = np.hstack([shapes[:, None] >> np.arange(len(FEATURES)) & 1, np.ones((len(n), 1))])
        y = np.eye(k)[labels]
        share = np.sqrt(n) / np.sqrt(n).sum()
        for _ in range(1500):
            z = x @ weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            weights += 2.0 * (x.T @ ((y - p) * share[:, None]) - 1e-4 * weights)
    pairs = np.zeros((2, k, k))
    for e in range(2):
        c = np.ones((k, k))
        for kind, what, n in counts:
            if kind == e:
                c[what >> 8, what & 255] += n / 2
                c[what & 255, what >> 8] += n / 2
        pairs[e] = np.clip(np.log(c * c.sum() / c.sum(1)[:, None] / c.sum(0)), -2.0, 2.0)
    return Field(weights, pairs)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def detect(
    docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of `docs`: its id, n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    The counts and the digest are of the patterns' finds; `spans` lists all, as
    kind:start:end in code points. A null or empty text has none. Repeated rows and null
    ids give rows like others; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.pairs))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = [f"n_{k}" for k in KINDS]

    def run(batches):
        field = Field(*shared.value)
        for batch in batches:
            found = field.spans(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64()) for k in range(4)],
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]),
                    pa.array([joined(x) for _, x in found], pa.string()),
                ],
                names=["doc_id", *counts, "base_sha256", "spans"],
            )

    schema = T.StructType([rows.schema["doc_id"]])
    for c in counts:
        schema = schema.add(c, T.LongType())
    schema = schema.add("base_sha256", T.StringType()).add("spans", T.StringType())
    out = rows.mapInArrow(run, schema)
    return out.withColumnRenamed("doc_id", doc_id)


def blank(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with its spans' kinds in their place; of overlapping ones the first counts."""
    parts, at = [], 0
    for s, e, k in spans:
        if s >= at:
            parts += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The rows of `docs` with all that was found in `text` replaced by its kind in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.pairs))
    at = docs.columns.index(text)

    def run(batches):
        field = Field(*shared.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = field.spans(texts)
            new = [blank(t, s) if s else t for t, (_, s) in zip(texts, found)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
