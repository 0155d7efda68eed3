"""Byte-level BPE, conversation repair, conversation tries."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from helpers_llm import as_counter
from pyspark.sql import functions as F, types as T

from revsync.llm import byte_bpe, catalog, prefix_trie, turn_repair

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CONVERSATIONS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# --- byte-level BPE ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark, docs_of, rows_of_corpus, library):
    texts = [
        "<|endoftext|> isn't special", "\x1c\x85\xa0  ", "it's I'LL we've", "x" * 5000, "ab" * 3000,
        "\U00010940՘͸ mixed \U0001f600 漢字かな交じり文", "tail spaces   ", " \n\n lead",
    ]
    rows = rows_of_corpus + [(2000 + i, t, None, None) for i, t in enumerate(texts)]
    got = byte_bpe.round_trip(docs_of(spark, rows, clash=True), RANKS, public_tokenizers.PATTERN)
    want = Counter()
    for i, t, _, _ in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")] += 1
    assert as_counter(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_trees_agree_with_the_library(library):
    """Long pieces, trees side by side, and characters that two versions of Unicode class otherwise."""
    ranks = byte_bpe.read_ranks(RANKS)
    pairs = byte_bpe.Pairs(ranks)
    r = random.Random(5)
    pieces = ["".join(r.choices("etaonis rhé漢", k=r.randint(1, 20))).encode() for _ in range(500)]
    for size in (2, 4, 8, 16, 32, 64):
        some = [p for p in pieces if 2 <= len(p) <= size and p not in ranks]
        for p, ids in zip(some, byte_bpe.merge_many(some, size, pairs) if some else []):
            assert byte_bpe.array("i", ids).tolist() == byte_bpe.merge(p, ranks)
    cut = byte_bpe.Cutter(public_tokenizers.PATTERN)
    for _ in range(500):
        text = "".join(chr(r.choice([r.randrange(0x3000), r.randrange(0x10000, 0x32000)])) if r.random() < 0.4 else r.choice("a 1!'s\n") for _ in range(20))
        ids = [i for piece in cut(text) for i in byte_bpe.merge(piece.encode(), ranks)]
        assert ids == library.encode_ordinary(text)


def test_ids_and_bytes(spark, docs_of, library):
    rows = [(1, "héllo wörld", None, None), (2, "", None, None), (3, None, None, None)]
    ids = byte_bpe.encode(docs_of(spark, rows), RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in ids.collect()} == {1: library.encode_ordinary("héllo wörld"), 2: [], 3: []}
    ids = ids.withColumn("ids", F.when(F.col("doc_id") != 2, F.slice("ids", 1, 2))).withColumn("bytes", F.lit("kept"))
    out = {r.doc_id: r for r in byte_bpe.decode(ids, RANKS).collect()}
    assert bytes(out[1].decoded) == library.decode_bytes(library.encode_ordinary("héllo wörld")[:2])
    assert out[2].decoded is None and out[1].bytes == "kept"
    unknown = spark.createDataFrame([([60_000],)], "ids array<int>")
    with pytest.raises(Exception):
        byte_bpe.decode(unknown, RANKS).collect()
    assert byte_bpe.encode(docs_of(spark, [], clash=True), RANKS, public_tokenizers.PATTERN).count() == 0


# --- repair of conversations -------------------------------------------------------------


def cheapest(turns):
    """Every sequence of edits, as long as it is not dearer than the best one."""
    best = (3 * len(turns) + 1, "")

    def go(i, last, cost, audit):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(turns) and last in ("", "a"):
            best = min(best, (cost, audit))
        then = "a" if last == "u" else "u"
        go(i, then, cost + 2, audit + "I") if cost + 2 <= best[0] else None
        if i < len(turns):
            go(i + 1, last, cost + 3, audit + "D")
            if turns[i] != "x":
                left = turns[i].isupper()
                same = turns[i].lower() == then
                go(i + 1, then, cost + left + (0 if same else 2), audit + ("K" if same else "R"))
                if last == "" and turns[i].lower() == "s":
                    go(i + 1, "s", cost + left, audit + "K")

    go(0, "", 0, "")
    return best


def test_alignment_is_the_cheapest_and_least():
    r = random.Random(2)
    some = ["".join(t) for n in range(3) for t in itertools.product("xsuaoSUAO", repeat=n)]
    some += ["".join(r.choices("xsuauaoSUA", k=r.randint(3, 6))) for _ in range(150)]
    for turns in some:
        found = turn_repair.align(turns)
        assert found[:2] == cheapest(turns), turns
        assert turn_repair.fold(turns) == found


def test_wide_bands_are_folded(monkeypatch):
    r = random.Random(4)
    some = ["".join(r.choices("xsuauauaoSUAO", k=r.randint(0, 80))) for _ in range(200)]
    wanted = list(map(turn_repair.align, some))
    monkeypatch.setattr(turn_repair, "CELLS", 0)
    assert list(map(turn_repair.align, some)) == wanted


SPACES = " \t\n\x0b\x0c\r"


def expected_repairs(rows, damage=True):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damage else 9
        if kind:
            role = "user" if kind == 4 else role
            text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
            by[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, codes, counts = set(), "", Counter()
        for turn, role, text in turns:
            bare = text.rstrip(SPACES)
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not bare or (role, text) in seen:
                counts["duplicate" if bare else "blank"] += 1
                code = "x"
            elif bare[-1] not in ".!?":
                counts["truncated"] += 1
                code = code.upper()
            seen.add((role, text))
            codes += code
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = {t[0] for t in turns} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit = cheapest(codes)
        out, i = [], 0
        for e in audit:
            last = out[-1][0] if out else ""
            then = "assistant" if last[:1] == "u" else "user"
            if e in "IR":
                out.append((then, "" if e == "I" else turns[i][2]))
            elif e == "K":
                out.append(turns[i][1:])
            i += e != "I"
        yield conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha("\n".join(map(":".join, out)))


def some_conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 7)):
            role = r.choice(["user", "assistant", "ua"[t % 2] + "x", "system", None, "", "tool"])
            text = r.choice(["Fine.", "fine", " \t", "", None, f"Said {t}!", "Ünï?\n", "a.b", "cut off\n"])
            rows.append((c, r.choice([t, t, t, None, 3]), role, text))
    rows += [rows[0], rows[0], (None, 1, "user", "Hello."), (None, None, "assistant", "Hi."), (-7, -3, "user", "So.")]
    return rows


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_report(spark, tmp_path):
    rows = some_conversations(7, 60)
    spark.createDataFrame(rows, CONVERSATIONS).withColumns({c: F.lit("x") for c in ("conv", "code", "place", "out")}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.op12_turn_repair(spark, str(tmp_path))
    assert as_counter(got, *COLUMNS) == Counter(expected_repairs(rows))


def test_repaired_turns(spark):
    rows = [(1, 1, "user", "Hello."), (1, 2, "user", "Still there?"), (1, 3, "system", "x"), (2, 1, "system", "Be kind."), (2, 2, "tool", "Yes.")]
    told = turn_repair.faults(turn_repair.rows_of(spark.createDataFrame(rows, CONVERSATIONS), *CONVERSATIONS.names))
    turns = turn_repair.repaired(told, turn_repair.audits(told)).orderBy("conv", "out").collect()
    assert [(r.conv, r.edit, r.role, r.text) for r in turns] == [
        (1, "K", "user", "Hello."), (1, "I", "assistant", ""), (1, "K", "user", "Still there?"), (1, "R", "assistant", "x"),
        (2, "K", "system", "Be kind."), (2, "I", "user", ""), (2, "R", "assistant", "Yes."),
    ]


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert catalog.op12_turn_repair(spark, str(tmp_path)).count() == 0
    assert catalog.op13_prefix_trie(spark, str(tmp_path)).count() == 0


# --- tries -------------------------------------------------------------------------------


def test_double_array():
    r = random.Random(1)
    sequences = sorted({tuple(r.choices(range(40), k=r.randint(0, 6))) for _ in range(300)})
    trie = prefix_trie.DoubleArray(list(map(list, sequences)))
    prefixes = {s[:k] for s in sequences for k in range(len(s) + 1)}
    slots = {}
    for p in prefixes:
        way = trie.walk(list(p))
        assert len(way) == len(p) + 1
        slots[p] = way[-1]
    assert len(set(slots.values())) == len(prefixes)
    for p in prefixes:
        for c in range(40):
            assert (trie.step(slots[p], c) >= 0) == ((*p, c) in prefixes)


def expected_nodes(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (-1 if c < 0 else 1)
        path = tuple(t[2:] for t in own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)]
        children = [q for q in below if len(q) == len(p) + 1]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        parent = members[p[:-1]][0] if p else None
        yield m[0], len(p), parent, len(m), len(children), len(leaves), saved, sha(",".join(map(str, ends[p])))


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_conversations():
    r = random.Random(3)
    rows = []
    for c in [*range(0, 130), *range(200, 230), *range(301, 340), -5, -105, -100]:
        hot = r.random() < 0.4
        for t in range(r.randint(1, 9)):
            text = "same" if hot else r.choice(["a", "b", "éé", None, ""])
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "assistant"]) if not hot else "user", text))
    rows += [(500, t, "user", f"turn {t}") for t in range(300)]  # a long one
    rows += [rows[5], rows[5], (None, 1, "user", "left out"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("shard", [1, 40, 50_000])
def test_trie(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    rows = trie_conversations()
    spark.createDataFrame(rows, CONVERSATIONS).withColumns({c: F.lit("x") for c in ("conv", "key", "h", "base", "n")}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalog.op13_prefix_trie(spark, str(tmp_path))
    assert as_counter(got, *NODE) == Counter(expected_nodes(rows))


def test_operators_leave_no_intermediate_data(spark, tmp_path):
    import glob
    import os

    from revsync import session

    rows = some_conversations(1, 10)
    spark.createDataFrame(rows, CONVERSATIONS).write.parquet(f"{tmp_path}/conversations.parquet")
    base = f"{session.shared_dir(spark).removeprefix('file:')}/revsync"
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    for name, result in (("op12_turn_repair", "repairs"), ("op13_prefix_trie", "trie")):
        catalog.queries()[name](spark, str(tmp_path)).count()
        assert result in {x.split("-")[0] for x in set(os.listdir(base)) - before}
    inner = ("faults", "audits", "paths", "classes", "shards", "merged", "counted")
    assert not [x for n in inner for x in glob.glob(f"{base}/{n}-*") + glob.glob(f"{base}/_scratch/*/{n}")]
