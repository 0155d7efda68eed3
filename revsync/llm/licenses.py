"""License scans: ordered signature rules over a text's words, all in native expressions.

A rule is a regular expression over words, the words it needs, a label and a rank. Only
rules whose words all occur in a text are tried on it, so most texts cost one pass over
their words. Every match is an interval of words. A match that lies within another is
suppressed if that one's rule ranks as high or higher; the base phrases' places are always
reported.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from revsync.llm.common import stage, words


@dataclass(frozen=True)
class Rule:
    """`pattern` is over lower-case words with one space between them; `needs` are words that
    every match holds. A higher `rank` suppresses what lies within its matches."""

    label: str
    pattern: str
    needs: tuple[str, ...]
    rank: int
    base: bool = False

    def regex(self) -> str:
        """The pattern over `word#index` with one space between: each word's index follows it."""
        return r"(?<![^ ])(?:" + self.pattern.replace(" ", r"#\d+ ") + r")#\d+"


# Phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Label, the name in words (a pattern) and a word that the name always holds.
FAMILIES = [
    ("0bsd", "(zero clause bsd|bsd zero clause|0bsd)", ""),
    ("afl-3.0", "academic free( license)?( v3| version 3| 3)?( 0)?", "academic"),
    ("agpl-3.0", "(gnu )?affero general public( license)?( v3| version 3)?( 0)?", "affero"),
    ("apache-1.1", "apache( software)?( license)? (version )?1 1", "apache"),
    ("apache-2.0", "apache( software)?( license)?( version)?( 2| v2)?( 0)?", "apache"),
    ("artistic-2.0", "(perl )?artistic( license)?( version)?( 2)?( 0)?", "artistic"),
    ("beerware", "(beerware|beer ware)", ""),
    ("bsd-2-clause", "((simplified|2 clause|two clause) bsd|bsd (2 clause|two clause))", "bsd"),
    ("bsd-3-clause", "((modified|revised|new|3 clause|three clause) bsd|bsd (3 clause|three clause))", "bsd"),
    ("bsd-4-clause", "((original|4 clause|four clause) bsd|bsd (4 clause|four clause))", "bsd"),
    ("bsl-1.0", "boost( software)?( license)?( version)?( 1)?( 0)?", "boost"),
    ("busl-1.1", "business source( license)?( version)?( 1)?( 1)?", "business"),
    ("cc-by-4.0", "(cc|creative commons) (by|attribution)( 4)?( 0)?", ""),
    ("cc-by-nc-4.0", "(cc|creative commons) (by|attribution) (nc|non commercial|noncommercial)( 4)?( 0)?", ""),
    ("cc-by-nc-nd-4.0", "(cc|creative commons) (by|attribution) (nc|noncommercial) (nd|noderivatives)( 4)?( 0)?", ""),
    ("cc-by-nc-sa-4.0", "(cc|creative commons) (by|attribution) (nc|noncommercial) (sa|sharealike)( 4)?( 0)?", ""),
    ("cc-by-nd-4.0", "(cc|creative commons) (by|attribution) (nd|noderivatives)( 4)?( 0)?", ""),
    ("cc-by-sa-4.0", "(cc|creative commons) (by|attribution) (sa|share alike|sharealike)( 4)?( 0)?", ""),
    ("cc0-1.0", "(cc0|cc zero|creative commons zero)( 1)?( 0)?", ""),
    ("cddl-1.0", "common development and distribution( license)?( 1)?( 0)?", "development"),
    ("cecill-2.1", "cecill( 2)?( 1)?", "cecill"),
    ("cpl-1.0", "common public( license)?( 1)?( 0)?", "common"),
    ("ecl-2.0", "educational community( license)?( 2)?( 0)?", "educational"),
    ("epl-2.0", "eclipse public( license)?( v 2| 2)?( 0)?", "eclipse"),
    ("eupl-1.2", "european union public( licence| license)?( 1)?( 2)?", "european"),
    ("gfdl-1.3", "(gnu )?free documentation( license)?( version)?( 1)?( 3)?", "documentation"),
    ("gpl-1.0", "(gnu )?general public license( version| v)? 1( 0)?", "general"),
    ("gpl-2.0", "(gnu )?general public license( version| v)? 2( 0)?", "general"),
    ("gpl-3.0", "(gnu )?general public license( version| v)? 3( 0)?", "general"),
    ("gpl-any", "(gnu )?(general public|gpl)", ""),
    ("isc", "(isc|internet systems consortium)", ""),
    ("lgpl-2.1", "(gnu )?lesser general public( license)?( version| v)? 2( 1)?", "lesser"),
    ("lgpl-3.0", "(gnu )?lesser general public( license)?( version| v)?( 3)?( 0)?", "lesser"),
    ("lppl-1.3c", "latex project public( license)?( 1)?( 3c)?", "latex"),
    ("mit", "(mit|expat|x11)", ""),
    ("mit-0", "mit (0|no attribution)", "mit"),
    ("mpl-1.1", "mozilla public( license)?( version)? 1( 1)?", "mozilla"),
    ("mpl-2.0", "mozilla public( license)?( version)?( 2)?( 0)?", "mozilla"),
    ("ms-pl", "microsoft public", "microsoft"),
    ("ms-rl", "microsoft reciprocal", "microsoft"),
    ("ncsa", "(university of illinois )?ncsa( open source)?", "ncsa"),
    ("odbl-1.0", "open (data commons open )?database( license)?( 1)?( 0)?", "database"),
    ("ofl-1.1", "(sil )?open font( license)?( version)?( 1)?( 1)?", "font"),
    ("openssl", "openssl", "openssl"),
    ("osl-3.0", "open software( license)?( 3)?( 0)?", "software"),
    ("php-3.01", "php( license)?( version)? 3( 01)?", "php"),
    ("postgresql", "postgresql", "postgresql"),
    ("python-2.0", "(python software foundation|psf)( license)?( 2)?( 0)?", ""),
    ("sspl-1.0", "server side public( license)?( 1)?( 0)?", "server"),
    ("unlicense", "unlicense", "unlicense"),
    ("vim", "vim", "vim"),
    ("w3c", "w3c( software)?( notice)?", "w3c"),
    ("wtfpl", "(wtfpl|do what the fuck you want to public)", ""),
    ("zlib", "zlib( libpng)?", "zlib"),
    ("zpl-2.1", "zope public( license)?( 2)?( 1)?", "zope"),
]

# The same by SPDX id or usual abbreviation, as words, and the word it holds.
SHORT = [
    ("afl-3.0", "afl( v?3)?( 0)?", "afl"),
    ("agpl-3.0", "(gnu )?agpl( version)?( v?3)?( 0)?", "agpl"),
    ("agpl-3.0", "(gnu )?agplv3", "agplv3"),
    ("bsl-1.0", "bsl( 1)?( 0)?", "bsl"),
    ("busl-1.1", "busl( 1)?( 1)?", "busl"),
    ("cddl-1.0", "cddl( 1)?( 0)?", "cddl"),
    ("cpl-1.0", "cpl( 1)?( 0)?", "cpl"),
    ("ecl-2.0", "ecl( 2)?( 0)?", "ecl"),
    ("epl-2.0", "epl( v?2)?( 0)?", "epl"),
    ("eupl-1.2", "eupl( v?1)?( 2)?", "eupl"),
    ("gfdl-1.3", "(gnu )?gfdl( v?1)?( 3)?", "gfdl"),
    ("gpl-1.0", "(gnu )?gpl( version)? v?1( 0)?", "gpl"),
    ("gpl-2.0", "(gnu )?gpl( version)? v?2( 0)?", "gpl"),
    ("gpl-3.0", "(gnu )?gpl( version)? v?3( 0)?", "gpl"),
    ("lgpl-2.1", "(gnu )?lgpl( version)? v?2( 1)?", "lgpl"),
    ("lgpl-2.1", "(gnu )?lgplv2( 1)?", "lgplv2"),
    ("lgpl-3.0", "(gnu )?lgpl( version)?( v?3)?( 0)?", "lgpl"),
    ("lgpl-3.0", "(gnu )?lgplv3", "lgplv3"),
    ("lppl-1.3c", "lppl( 1)?( 3c)?", "lppl"),
    ("mpl-1.1", "mpl( version)? v?1( 1)?", "mpl"),
    ("mpl-2.0", "mpl( version)?( v?2)?( 0)?", "mpl"),
    ("ms-pl", "ms pl", "pl"),
    ("ms-rl", "ms rl", "rl"),
    ("odbl-1.0", "odbl( 1)?( 0)?", "odbl"),
    ("ofl-1.1", "(sil )?ofl( 1)?( 1)?", "ofl"),
    ("osl-3.0", "osl( 3)?( 0)?", "osl"),
    ("python-2.0", "python 2 0", "python"),
    ("sspl-1.0", "sspl( 1)?( 0)?", "sspl"),
    ("zpl-2.1", "zpl( 2)?( 1)?", "zpl"),
]

# How a name is stated (X stands for it), words that the form always holds, rank.
FORMS = [
    ("(dual |re )?licensed under( the)?( terms of( the)?)? X( license| licence)?", ("licensed", "under"), 6),
    ("(released|distributed|made available|published|provided) under( the)?( terms of( the)?)? X( license| licence)?", ("under",), 6),
    ("(under|subject to|governed by|covered by)( the)?( terms( and conditions)? of)( the)? X( license| licence)?", ("terms", "of"), 5),
    ("spdx license identifier X( only| or later)?", ("spdx", "identifier"), 7),
    ("(the |this )?X license( agreement)?", ("license",), 4),
    ("(the |this )?X licence( agreement)?", ("licence",), 4),
    ("license( type)?( is)? X", ("license",), 3),
]

# Label, pattern, words it holds, rank.
PHRASES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission", "charge"), 8),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission", "distribute"), 8),
    ("bsd", "redistribution and use in source and binary forms( with or without modification)?( are permitted)?", ("redistribution", "binary"), 8),
    ("bsd-3-clause", "neither the name of .{1,120}? nor the names of its contributors", ("neither", "contributors"), 8),
    ("gpl", "this program is free software you can redistribute it and or modify it", ("program", "redistribute"), 8),
    ("gpl-or-later", "either version [123] of the license or at your option any later version", ("either", "option"), 8),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",), 8),
    ("zlib", "this software is provided as is without any express or implied warranty", ("software", "warranty"), 7),
    ("no-warranty", "(without|no) warranty of any kind( express or implied)?", ("warranty",), 2),
    ("no-warranty", "as is without warranty", ("without", "warranty"), 2),
    ("no-warranty", "as is without warranties", ("without", "warranties"), 2),
    ("public-domain", "(dedicated to|released into|in|placed in) the public domain", ("public", "domain"), 5),
    ("public-domain", "public domain dedication", ("public", "domain"), 5),
    ("copyright", "copyright( c)? [12][0-9]{3}( [12][0-9]{3})?", ("copyright",), 3),
    ("reserved", "all rights( are)? reserved", ("all", "rights"), 4),
    ("reserved", "no rights( are)? (granted|implied)", ("no", "rights"), 3),
    ("some-rights", "some rights reserved", ("some", "rights"), 4),
    ("proprietary", "(proprietary and confidential|confidential and proprietary)", ("proprietary",), 5),
    ("proprietary", "may not be (copied|reproduced|distributed)( or (copied|reproduced|distributed))?", ("may", "not", "be"), 3),
    ("non-commercial", "(for )?non commercial (use|purposes)( only)?", ("non", "commercial"), 3),
    ("non-commercial", "(for )?noncommercial (use|purposes)( only)?", ("noncommercial",), 3),
    ("attribution", "(with|requires|give) (appropriate )?attribution", ("attribution",), 1),
    ("attribution", "(with|give) (appropriate )?credit", ("credit",), 1),
    ("see-license", "see( the)? (accompanying |included )?license( file)?( for details)?", ("see", "license"), 2),
    ("license-unknown", "licensed under( the)?", ("licensed",), 1),
    ("license-unknown", "license agreement", ("license", "agreement"), 1),
]


def rules() -> list[Rule]:
    """Base phrases, stock phrases, and every family in every form."""
    out = [Rule(label, p, tuple(p.split(" ")), 1, True) for p, label in BASE]
    out += [Rule(label, p, needs, rank) for label, p, needs, rank in PHRASES]
    for label, name, word in FAMILIES + SHORT:
        for form, needed, rank in FORMS:
            pattern = form.replace("X", name if name.startswith("(") else f"({name})")
            out.append(Rule(label, pattern, (*needed, word) if word else needed, rank))
    return out


def _matched(rows: DataFrame, all_rules: list[Rule]) -> DataFrame:
    """`rows` with words `w`, and `m`: (start, end, rank, rule, label, base) of all matches.

    Every step's column is read more than once by the next, which keeps it from being
    evaluated anew for every rule.
    """
    table = F.from_json(
        F.lit(json.dumps([
            {"regex": r.regex(), "needs": r.needs,
             "is": {"rank": r.rank, "rule": i, "label": r.label, "base": r.base}}
            for i, r in enumerate(all_rules)
        ])),
        "array<struct<regex:string,needs:array<string>,"
        "is:struct<rank:int,rule:int,label:string,base:boolean>>>",
    )
    keywords = F.array(*[F.lit(x) for x in sorted({x for r in all_rules for x in r.needs})])
    wanted = F.filter(table, lambda r: F.size(F.array_except(r["needs"], F.col("there"))) == 0)
    numbered = F.array_join(
        F.transform("w", lambda x, i: F.concat(x, F.lit("#"), i.cast("string"))), " "
    )

    def found(r: Column) -> Column:
        return F.transform(
            F.regexp_extract_all("numbered", r["regex"], F.lit(0)),
            lambda m: F.struct(
                F.regexp_extract(m, r"^[^#]*#(\d+)", 1).cast("int").alias("start"),
                F.regexp_extract(m, r"#(\d+)$", 1).cast("int").alias("end"),
                r["is"]["rank"].alias("rank"), r["is"]["rule"].alias("rule"),
                r["is"]["label"].alias("label"), r["is"]["base"].alias("base"),
            ),
        )

    return (
        rows.withColumn("there", F.array_intersect(keywords, F.col("w")))
        .withColumn("wanted", F.when(F.size("there") > 0, wanted))
        .withColumn("numbered", F.when(F.size("wanted") > 0, numbered))
        .withColumn(
            "m",
            F.when(F.length("numbered") > 0, F.flatten(F.transform("wanted", found))),
        )
    )


def scan(
    docs: DataFrame,
    all_rules: list[Rule] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row of `docs`: its id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, n_found (matches that are left).

    `first_word` and `last_word` are null without a base phrase, the labels then empty if no
    rule matches either. `score` is the highest rank that is left, as a share of the highest
    there is. Null and empty texts have no words. Repeated rows get the same result each;
    other columns are left out. Of matches over the same words by rules of the same rank the
    one of the earlier rule stays.
    """
    all_rules = all_rules or rules()
    top = max(r.rank for r in all_rules)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), words(F.col(text)).alias("w")
    )
    seen = stage(
        _matched(rows, all_rules).select(
            "doc_id", "row", F.size("w").cast("long").alias("n_words"), "m"
        ),
        "license-matches",
    )
    m = seen.where(F.size("m") > 0).dropDuplicates(["row"]).select("row", F.inline("m"))
    before = (
        Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("rank"), "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = F.lit(-1)
    for rank in sorted({r.rank for r in all_rules}):  # how far matches of each rank reach
        far = F.coalesce(F.max(F.when(F.col("rank") >= rank, F.col("end"))).over(before), F.lit(-1))
        reach = F.when(F.col("rank") == rank, far).otherwise(reach)
    m = m.withColumn("left", F.col("end") > reach)
    start_of_base = F.when(F.col("base"), F.col("start").cast("long"))
    per_row = m.groupBy("row").agg(
        F.count(start_of_base).alias("n_base"),
        F.min(start_of_base).alias("first_word"),
        F.max(start_of_base).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(F.col("base") | F.col("left"), F.col("label"))).alias("labels"),
        F.max(F.when(F.col("left"), F.col("rank") / float(top))).alias("score"),
        F.count(F.when(F.col("left"), 1)).alias("n_found"),
    )
    listed = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array())), ",").alias(c)
    return seen.drop("m").join(per_row, "row", "left").select(
        F.col("doc_id").alias(doc_id), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word", "last_word", listed("base_labels"), listed("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_found", F.lit(0)).alias("n_found"),
    )
