"""Benchmark decontamination by a positional inverted index of the training texts.

The index holds a posting (term, row, position) for every training word that occurs in the
benchmark at all. A benchmark window, ten words in a row, is looked for from its rarest
words: their postings, moved back by the word's offset in the window, must meet in one
start. Where they do, the window is compared word by word with the text. Where they only
meet nearby, the window is a proximity match.

A posting list is never gathered: lists meet in an aggregate by (row, window, start), which
combines within tasks first, so a word or passage that is everywhere is many small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revsync.llm.common import small, stage, words

WINDOW = 10
#: Words of a window, the rarest ones, whose postings are intersected.
RAREST = 2
#: Rows of benchmark tables that are broadcast at most; larger ones are shuffled instead.
BROADCAST_ROWS = 200_000
#: Rows with matches are first told from others by this many values of their key, which are
#: broadcast whatever the number of rows; only texts that pass are shuffled.
KEY_VALUES = 1 << 18


def windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """`item`, `window` (its words) of every window; a shorter item is one window."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return (
        w.where(F.size("w") > 0)
        .select("item", "w", F.explode(starts).alias("s"))
        .select("item", F.expr(f"slice(w, s, {width})").alias("window"))
    )


def row_key(doc_id: str, text: str) -> Column:
    """A row's key: rows that repeat share it, and so their result."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def index(docs: DataFrame, doc_id: str, text: str, terms: DataFrame) -> DataFrame:
    """Postings (term, row, pos) of the words whose hash is in `terms`, written out."""
    tokens = docs.select(
        row_key(doc_id, text).alias("row"), F.posexplode(words(F.col(text))).alias("pos", "word")
    ).select(F.xxhash64("word").alias("term"), "row", "pos")
    return stage(tokens.join(small(terms, BROADCAST_ROWS), "term"), "postings")


def anchors(places: DataFrame, counts: DataFrame, rarest: int) -> DataFrame:
    """`win`, `term`, `off`, `bit`: the rarest words of each window, a bit for each.

    `places` has a row per window and word, so a window is a group of `WINDOW` rows at most.
    """
    return (
        places.join(counts, "term")  # a word that is nowhere ends its window's search
        .groupBy("win", "width")
        .agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("t"))
        .where(F.size("t") == F.col("width"))
        .select("win", F.posexplode(F.slice("t", 1, rarest)).alias("rank", "t"))
        .select("win", "t.term", "t.off", F.expr("shiftleft(1L, rank)").alias("bit"))
    )


def meet(postings: DataFrame, anchored: DataFrame, widths: DataFrame, rarest: int, slop: int) -> DataFrame:
    """(row, win, width, starts, near): per stretch of `slop` + 1 starts the single starts in
    which all of a window's rarest words meet, and those from which on they meet within `slop`.

    A start's bits have a byte of their own in a number. Each goes to its own stretch and, as
    `next`, to the one before it, so it doesn't matter where the stretches begin. `near` has a
    start and the bits of it and the `slop` starts after it.
    """
    span = slop + 1
    bits = F.expr(f"shiftleft(bit, cast(8 * pmod(pos - off, {span}) as int))")
    met = (
        postings.join(small(anchored, BROADCAST_ROWS), "term")
        .select("row", "win", F.floor((F.col("pos") - F.col("off")) / span).cast("int").alias("at"), bits.alias("bits"))
        .select("row", "win", "bits", F.explode(F.expr("array(at, at - 1)")).alias("stretch"), "at")
        .groupBy("row", "win", "stretch")
        .agg(
            F.bit_or(F.expr("if(at = stretch, bits, 0L)")).alias("own"),
            F.bit_or(F.expr("if(at = stretch, 0L, bits)")).alias("next"),
        )
        .join(small(widths, BROADCAST_ROWS), "win")
        .withColumn("all", F.expr(f"shiftleft(1L, least(width, {rarest})) - 1"))
    )
    byte = [f"(shiftright({x}, {8 * k}) & all)" for x in ("own", "next") for k in range(span)]
    meets = [f"({byte[k]} <> 0 and ({' | '.join(byte[k : k + span])}) = all)" for k in range(span)]
    starts = [
        F.when(F.expr(f"{byte[k]} = all and stretch * {span} + {k} >= 0"), F.expr(f"stretch * {span} + {k}"))
        for k in range(span)
    ]
    near = [
        F.expr(f"if({meets[k]}, struct(stretch * {span} + {k} as s, array({', '.join(byte[k : k + span])}) as bits, all), null)")
        for k in range(span)
    ]
    return met.where(" or ".join(meets)).select(
        "row", "win", "width", F.array_compact(F.array(*starts)).alias("starts"),
        F.array_compact(F.array(*near)).alias("near"),
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    rarest: int = RAREST,
    slop: int = 3,
) -> DataFrame:
    """Per row of `docs`: its id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    A word is hit if it stands in an occurrence of a window of any item. `n_near` counts
    proximity matches: starts of a window by one of its rarest words from which on, within
    `slop`, all of them have one, occurrences of the window itself left out (at most 8 rarest
    words, and a slop of 7). Null and empty texts have no words and hit nothing;
    an item without words or text has no window; an item without an id is hit but neither
    counted nor listed. Repeated rows each get the same result; other columns are left out.
    """
    win = stage(
        windows(items, item_id, item_text, width)
        .select("item", "window", F.xxhash64("window").alias("win"))
        .groupBy("win")
        .agg(F.first("window").alias("window"), F.collect_set("item").alias("items")),
        "windows",
    )
    places = stage(
        win.select(
            "win", F.size("window").alias("width"), F.posexplode("window").alias("off", "word")
        ).select("win", "width", "off", F.xxhash64("word").alias("term")),
        "window-words",
    )
    postings = index(docs, doc_id, text, stage(places.select("term").distinct(), "terms"))
    counts = stage(postings.groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    anchored = stage(anchors(places, counts, rarest), "anchors")
    found = stage(
        meet(postings, anchored, win.select("win", F.size("window").alias("width")), rarest, slop)
        .join(small(win.select("win", "items"), BROADCAST_ROWS), "win")
        .groupBy("row")
        .agg(F.collect_list(F.struct("win", "width", "items", "starts", "near")).alias("found")),
        "matches",
    )

    value = F.pmod("row", F.lit(KEY_VALUES)).alias("value")
    values = stage(found.select(value).distinct(), "match-values")
    texts = docs.select(row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    near_texts = texts.select("*", value).join(F.broadcast(values), "value", "left_semi")
    judged = near_texts.join(found, "row").select("row", words(F.col("text")).alias("w"), "found")
    placed = F.flatten(
        F.transform("found", lambda m: F.transform(m["starts"], lambda s: m.withField("start", s)))
    )
    same = F.filter(
        placed, lambda m: F.xxhash64(F.slice(F.col("w"), m["start"] + 1, m["width"])) == m["win"]
    )
    covered = F.array_distinct(
        F.flatten(F.transform("hits", lambda m: F.sequence(m["start"], m["start"] + m["width"] - 1)))
    )
    listed = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda m: m["items"]))))
    near = F.expr(
        "size(filter(flatten(transform(found, m -> transform(m.near, x -> struct(m.win as win, x.s as s, x.bits as bits, x.all as all)))),"
        " x -> not array_contains(there, struct(x.win, x.s)) and x.all = aggregate("
        "transform(x.bits, (b, i) -> if(array_contains(there, struct(x.win, x.s + i as s)), 0L, b)), 0L, (a, b) -> a | b)))"
    )
    matched = (
        judged.select("row", "found", same.alias("hits"))
        .withColumn("there", F.transform("hits", lambda m: F.struct(m["win"].alias("win"), m["start"].alias("s"))))
        .select("row", covered.alias("c"), listed.alias("i"), near.cast("long").alias("n_near"))
        .select(
            "row", F.size("c").cast("long").alias("n_hit"), F.size("i").cast("long").alias("n_items"),
            F.sha2(F.array_join("i", ","), 256).alias("items_sha256"), "n_near",
        )
        .dropDuplicates(["row"])
    )
    counted = docs.select(
        F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row"),
        F.size(words(F.col(text))).cast("long").alias("n_words"),
    )
    none = F.lit(0).cast("long")
    return counted.join(matched, "row", "left").select(
        F.col("doc_id").alias(doc_id), "n_words", F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", none) > 0).alias("contaminated"), F.coalesce("n_near", none).alias("n_near"),
    )
