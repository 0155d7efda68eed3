"""License scans, decontamination, token counts, personal data, languages."""

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from helpers_llm import as_counter, words
from pyspark.sql import functions as F

from revsync.llm import decontaminate, language_bits, licenses, pii_crf, token_counts

LICENSED = [
    "This is licensed under CC BY-NC 4.0. All rights reserved, see cc-by.",
    "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0.",
    "cc by cc by general public license all rights reserved",
    "This work is licensed under the GNU General Public License, version 3. Permission is hereby "
    "granted, free of charge, to any person obtaining a copy",
    "cc by, all rights, reserved general PUBLIC\nlicenses; all-rights-reserved",
    "ccby occ by cc bye",
    "SPDX-License-Identifier: MIT (see the included license file)",
]


def expected_licenses(text, rules):
    w = words(text)
    numbered = " ".join(f"{x}#{i}" for i, x in enumerate(w))
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.regex(), numbered):
            at = [int(x) for x in re.findall(r"#(\d+)", m[0])]
            found.append((at[0], at[-1], r.rank, k, r.label, r.base))
    found = [m for m in found]
    left = [
        m for m in found
        if not any(
            o is not m and o[0] <= m[0] and o[1] >= m[1] and o[2] >= m[2]
            and ((o[0], -o[1], -o[2], o[3]) < (m[0], -m[1], -m[2], m[3]))
            for o in found
        )
    ]
    base = [m[0] for m in found if m[5]]
    top = max(r.rank for r in rules)
    return (
        len(w), len(base), min(base, default=None), max(base, default=None),
        ",".join(sorted({m[4] for m in found if m[5]})),
        ",".join(sorted({m[4] for m in found if m[5]} | {m[4] for m in left})),
        max((m[2] / top for m in left), default=0.0), len(left),
    )


def test_licenses(spark, docs_of, rows_of_corpus):
    rows = rows_of_corpus + [(1000 + i, t, None, None) for i, t in enumerate(LICENSED)]
    got = licenses.scan(docs_of(spark, rows, clash=True))
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_found"]
    want = Counter((i, *expected_licenses(t, licenses.rules())) for i, t, _, _ in rows)
    assert as_counter(got, *columns) == want


def test_license_rules_are_many_and_suppressed():
    rules = licenses.rules()
    assert len(rules) > 300 and all(r.needs for r in rules)
    n = expected_licenses(LICENSED[3], rules)
    assert n[5] == "gpl,gpl-3.0,mit"


def test_spdx_headers_of_short_ids(spark, docs_of):
    ids = sorted({label for label, _, _ in licenses.FAMILIES if label != "gpl-any"})
    rows = [(i, f"SPDX-License-Identifier: {x.upper()}", None, None) for i, x in enumerate(ids)]
    rows.append((len(ids), "licensed under the MPL", None, None))
    got = licenses.scan(docs_of(spark, rows)).orderBy("doc_id").collect()
    assert all(x in r.labels.split(",") for r, x in zip(got, [*ids, "mpl-2.0"]))


def expected_contamination(rows, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = Counter()
    for i, t, _, _ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i, len(w), len(hit), len(found), sha, bool(hit)] += 1
    return out


def test_contamination(spark, docs_of, rows_of_corpus):
    texts = [t for _, t, _, _ in rows_of_corpus if t and len(t.split()) > 25][:4]
    items = [(k, " ".join(t.split()[3:22]).upper()) for k, t in enumerate(texts)]
    items += [(11, "a b"), (12, None), (13, ""), (14, "never seen anywhere"), (0, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    got = decontaminate.contamination(docs_of(spark, rows_of_corpus, clash=True), bench)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert as_counter(got, *columns) == expected_contamination(rows_of_corpus, items)


def test_proximity_matches(spark, docs_of):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, item, None, None), (2, item.replace("five", "5 and"), None, None), (3, "ten nine one", None, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.contamination(docs_of(spark, rows), bench, slop=7).orderBy("doc_id").collect()
    assert [r.contaminated for r in got] == [True, False, False]
    assert [r.n_near > 0 for r in got][0] is False


def test_proximity_matches_at_every_displacement_and_alignment(spark, docs_of):
    item = "one two three four five six seven eight nine ten"
    moved = [(k, d) for k in range(8) for d in range(5)]  # words before the passage, words put into it
    texts = [" ".join(["pad"] * k + ["one"] + ["and"] * d + item.split()[1:]) for k, d in moved]
    texts += [f"{item} pad pad pad pad {texts[1]}"]  # an occurrence, and a near one elsewhere
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.contamination(docs_of(spark, rows), bench).orderBy("doc_id").collect()
    assert [r.n_near for r in got] == [int(1 <= d <= 3) for _, d in moved] + [1]
    assert [r.contaminated for r in got] == [d == 0 for _, d in moved] + [True]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(spark, docs_of, rows_of_corpus, tokenizer):
    odd = ["a<|endoftext|>b  <|endoftext|><|endoftext|>", "tab\t\tand\n\n  lines  \n end ", "it's I'll 12345 ½ 日本語 🙂🙂  x",
           "<|endoftext", "  ", "ﬁ ​ zero", "a" * 5000]
    rows = rows_of_corpus + [(2000 + i, t, None, None) for i, t in enumerate(odd)]
    got = token_counts.token_counts(
        docs_of(spark, rows, clash=True), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=50
    )
    want = Counter()
    for i, t, _, _ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert as_counter(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


PERSONAL = [
    "mail a.b+c@mail1.example.com, a@b@c.de and x@y or a@b.c_d@e.f.",
    "ip 1.2.3.4 and 10.20.30.400 and 1.2.3.4.5.6.7.8 or 001.2.3.255",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 and 4111111111111111 5500005555555559",
    "call +49 (170) 123-4567 or +1 23 or +1.202.555.0143 now +",
    "call +1 (988) 555-2485 today; later (988) 555-2485 again",
    "42 version 2.0. is here @ 17:00",
]


def plain_spans(t):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return [f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_personal_data(spark, docs_of, rows_of_corpus):
    rows = rows_of_corpus + [(3000 + i, t, None, None) for i, t in enumerate(PERSONAL * 3)]
    docs = docs_of(spark, rows, clash=True)
    got = pii_crf.detect(docs, pii_crf.train(docs, "doc_id", "text")).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in got) == Counter(
        (i, hashlib.sha256(",".join(plain_spans(t or "")).encode()).hexdigest()) for i, t, _, _ in rows
    )
    text = {i: t or "" for i, t, _, _ in rows if i is not None}
    for r in got:
        base = plain_spans(text.get(r.doc_id, "")) if r.doc_id is not None else []
        assert not Counter(base) - Counter(filter(None, r.spans.split(",")))
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)


def test_field_carries_labels_to_recurrences():
    """A number that recurs without what makes it certain takes its label from the first time."""
    pairs = pii_crf._fit([(-1, 1 << 5 << 8 | 4, 50), (-1, 1 << 3 << 8, 200), (1, 4 << 8 | 4, 80)]).pairs
    weights = pii_crf.np.zeros((len(pii_crf.FEATURES) + 1, 5))
    weights[-1, 0] = 0.5
    field = pii_crf.Field(weights, pairs)
    g = pii_crf.Graph()
    t = "+12025550143 some words between 12025550143"
    g.add(t, pii_crf.base_spans(t))
    p = field.marginals(g)
    g.edges = []
    alone = field.marginals(g)
    assert g.labels == [4, 0] and p[1, 4] > alone[1, 4] and p[1].argmax() == 4


def test_redaction(spark, docs_of):
    docs = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate([*PERSONAL, None, ""])], clash=True)
    got = pii_crf.redact(docs, pii_crf.Field(pii_crf.np.zeros((23, 5)), pii_crf.np.zeros((2, 5, 5))))
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[0].startswith("mail [EMAIL], ") and texts[6] is None and texts[7] == ""


def test_languages(spark, docs_of):
    speech = {"en": "the thing and that other thing with them ", "de": "und der schöne weiße größe nicht ",
              "fr": "le château où était très français ", "es": "el niño y la canción española "}
    rows = [(i, speech[la] * (1 + i % 5), la, None) for i in range(80) for la in [list(speech)[i % 4]]]
    rows += [(900, None, "en", "s"), (901, "", None, None), (902, "12 34 . !", "fr", None), (903, "x", None, None),
             (904, speech["de"] * 9000, None, None), (None, speech["fr"], None, None), rows[0], rows[0]]
    docs = docs_of(spark, rows, clash=True)
    learnt = docs.where(~language_bits.held_out("doc_id"))
    filters = language_bits.fit(learnt, "text", "lang", F.col("doc_id"))
    got = language_bits.identify(docs, filters).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    pred = {r.doc_id: r.lang_pred for r in got}
    assert all(pred[i] == la for i, t, la, _ in rows if i is not None and i < 900)
    assert [pred[i] for i in (900, 901, 902, 904)] == ["und", "und", "und", "de"] and pred[None] == "fr"
    assert {r.doc_id for r in docs.where(language_bits.held_out("doc_id")).collect()} == {
        i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    }
    assert language_bits.fit(docs.where("false"), "text", "lang", F.col("doc_id")).languages == []


def test_more_languages_than_a_word_has_bits(spark, docs_of):
    def word(i):
        return hashlib.md5(str(i).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))

    rows = [(100 * i + k, f"{word(i)} {word(i + 1000)} " * 3, f"l{i}", None) for i in range(130) for k in range(3 if i < 64 else 2)]
    docs = docs_of(spark, rows)
    filters = language_bits.fit(docs, "text", "lang", F.col("doc_id"))
    assert len(filters.languages) == 130
    got = {r.doc_id: r.lang_pred for r in language_bits.identify(docs, filters).collect()}
    assert got == {i: la for i, _, la, _ in rows}
