"""From raw documents to a training mix, in stages that each work on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revsync import session
from revsync.llm import bloom, decontaminate, jaccard_join, language_bits, mixing, pii_crf
from revsync.llm.catalog import WEIGHTS
from revsync.llm.common import scoped, stage, table  # noqa: F401


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: one whose text is null or has no letter goes."""
    learnt = docs.where(F.coalesce(~language_bits.held_out("doc_id"), F.lit(False)))
    with scoped(spark):
        filters = language_bits.fit(learnt, "text", "lang", F.col("doc_id"))
    if not filters.languages:  # nothing to learn from: whatever has a letter stays
        return docs.where(F.col("text").rlike(r"\p{L}"))
    others = [c for c in docs.columns if c != "doc_id"]
    judged = language_bits.identify(docs, filters, keep=others)
    return judged.where(F.col("lang_pred") != language_bits.UNDETERMINED).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by similar shingles the one with the smallest id.

    Rows that repeat an id and a text are one document. An id names one document: where it
    has several texts, all of them stay if any one's group keeps the id. A row without an id
    stays unless another such row has its text.
    """
    with scoped(spark) as keep:
        groups = jaccard_join.join(docs)
        kept = keep(groups.where("doc_id = component_id").select("doc_id"), "kept-ids")
        may_go = bloom.of_column(groups.where("doc_id <> component_id"), "doc_id")
    repeated = kept.groupBy("doc_id").count().where("count > 1").select("doc_id")
    # Texts are moved for a join only where the group has others.
    doubt, named = may_go(F.col("doc_id")), docs.where("doc_id is not null")
    named = (
        named.where(doubt).join(kept.distinct(), "doc_id", "left_semi").select(*docs.columns)
        .unionAll(named.where(~doubt))
    )
    if not repeated.isEmpty():
        named = named.dropDuplicates(["doc_id", "text"])
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return named.select(*docs.columns)
    return named.select(*docs.columns).unionAll(nameless.dropDuplicates(["text"]))


def _unused(docs: DataFrame, name: str) -> str:
    """A column name like `name` that `docs` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    key = _unused(docs, "row_key")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    with scoped(spark) as keep:
        found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), doc_id=key)
        hit = keep(found.where("contaminated").select(key).distinct(), "contaminated")
    return rows.join(hit, key, "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    with scoped(spark):
        field = pii_crf.train(docs, "doc_id", "text")
    done = pii_crf.redact(docs, field)
    return done.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a mix of the sources by weight takes of every document."""
    return mixing.mix(docs, WEIGHTS)


STAGES = [
    ("language", identify_language),
    ("near duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("mix", mix_sources),
]

#: Language identification and the field for personal data are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each one's rows written and read again for the next.

    What a stage read is removed once the next one's rows are written; those of the last
    but one stay, since the mix that reads them is returned unwritten.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        path = session.new_scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        docs = session.stage_at(function(spark, docs, sf_dir), path)
        if before:
            session.remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
