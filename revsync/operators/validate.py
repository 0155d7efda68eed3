"""Validation: what makes a canonical row a reject, and the tables' CHECK rules.

A rule is a predicate that is true for a broken row. Keeping a row needs only the
predicates, which stay inside generated code; messages are built for rejects alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from revsync import vocab
from revsync.functions import outcomes, text, times

_ISSUES = "array<struct<field:string,message:string>>"


@dataclass(frozen=True)
class Rule:
    field: str
    message: Column
    broken: Column


def _rule(field: str, message: str | Column, broken: Column) -> Rule:
    return Rule(field, F.lit(message), F.coalesce(broken, F.lit(False)))


def _source_id_rule() -> Rule:
    return _rule("sourceId", vocab.SOURCE_ID_REQUIRED, text.is_blank(F.col("source_id")))


def contact_rules() -> list[Rule]:
    email = F.col("email")
    return [
        _source_id_rule(),
        _rule("email", vocab.EMAIL_INVALID, (email != "") & ~email.rlike(vocab.EMAIL_PATTERN)),
    ]


def deal_rules() -> list[Rule]:
    return [_source_id_rule()]


def event_rules() -> list[Rule]:
    start, end = F.col("start_at"), F.col("end_at")
    epoch = times.at(times.EPOCH)
    return [
        _source_id_rule(),
        _rule(
            "status",
            F.format_string(vocab.EVENT_STATUS_UNRECOGNIZED, F.col("status")),
            ~F.col("status").isin(vocab.EVENT_STATUSES),
        ),
        _rule("start", vocab.EVENT_NO_TIMES, (start == epoch) & (end == epoch)),
        _rule("end", vocab.EVENT_END_BEFORE_START, end < start),
    ]


def payment_rules() -> list[Rule]:
    return [
        _source_id_rule(),
        _rule("amount", vocab.PAYMENT_AMOUNT_NEGATIVE, F.col("amount_minor") < 0),
    ]


def is_valid(rules: list[Rule]) -> Column:
    ok = F.col("normalize_ok")
    for r in rules:
        ok = ok & ~r.broken
    return ok


def issues(rules: list[Rule]) -> Column:
    """The broken rules as an array of (field, message)."""
    none = F.array().cast(_ISSUES)
    return F.concat(
        *[
            F.when(
                r.broken,
                F.array(F.struct(F.lit(r.field).alias("field"), r.message.alias("message"))),
            ).otherwise(none)
            for r in rules
        ]
    )


def issue_text(rules: list[Rule]) -> Column:
    """The broken rules in one line; empty where there are none."""
    return F.concat_ws(
        "; ", *[F.when(r.broken, F.concat(F.lit(f"{r.field}: "), r.message)) for r in rules]
    )


def reject_message(rules: list[Rule]) -> Column:
    return F.coalesce(
        F.col("normalize_error"), F.concat(F.lit("Validation failed: "), issue_text(rules))
    )


def check(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every row with `is_valid` and, for a reject, `reject_message` and `issues`."""
    return df.select(
        "*",
        is_valid(rules).alias("is_valid"),
        F.when(~is_valid(rules), reject_message(rules)).alias("reject_message"),
        issues(rules).alias("issues"),
    )


def split_valid_rejects(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Rows to go on with, and rejects; neither stops the other."""
    valid = df.where(is_valid(rules)).drop("normalize_ok", "normalize_error")
    rejects = df.where(~is_valid(rules)).select(
        "*", reject_message(rules).alias("reject_message"), issues(rules).alias("issues")
    )
    return valid, rejects


def failure_rows(
    rejects: DataFrame, entity_type: str, job_id: str | None, occurred_at: datetime | Column
) -> DataFrame:
    """Rejects as failure log rows."""
    when = occurred_at if isinstance(occurred_at, Column) else times.at(occurred_at)
    code = F.lit(vocab.MALFORMED_RESPONSE)
    context = F.to_json(
        F.struct(
            code.alias("code"),
            F.col("provider").alias("providerId"),
            F.lit(entity_type).alias("entityType"),
            F.lit(False).alias("retryable"),
            F.lit(False).alias("requiresFullResync"),
            F.lit(False).alias("isFatalForThisRun"),
            F.when(F.col("normalize_error").isNull(), F.col("source_id")).alias("sourceId"),
            F.when(F.col("normalize_error").isNull(), F.col("issues")).alias("issues"),
            F.when(F.col("normalize_error").isNotNull(), F.col("raw")).alias("raw"),
        )
    )
    return rejects.select(
        "provider",
        F.lit(entity_type).alias("entity_type"),
        F.lit(job_id).cast("string").alias("job_id"),
        code.alias("error_code"),
        F.col("reject_message").alias("message"),
        context.alias("context"),
        times.ntz(when).alias("occurred_at"),
    )


def union_failures(*logs: DataFrame) -> DataFrame:
    """One failure log out of several."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out


# ---- CHECK rules of the tables ---------------------------------------------


#: The tables that have rules.
TABLES = (
    "providers", "canonical_deals", "canonical_events", "canonical_payments", "sync_metadata",
    "job_history", "webhook_events", "payment_status_mappings", "canonical_record_audit",
)


def check_rules(table: str) -> list[tuple[str, Column]]:
    """(name, predicate true for an offending row), none for a table without rules. As in SQL,
    a null passes a CHECK."""
    c = F.col
    return {
        "providers": [
            ("provider_source_system_valid", ~c("source_system").isin(vocab.SOURCE_SYSTEMS))
        ],
        "canonical_deals": [("deal_amount_non_negative", c("amount_minor") < 0)],
        "canonical_events": [
            ("event_status_valid", ~c("status").isin(vocab.EVENT_STATUSES)),
            ("event_end_after_start", c("end_at") < c("start_at")),
        ],
        "canonical_payments": [
            ("payment_amount_non_negative", c("amount_minor") < 0),
            ("payment_canonical_status_valid", ~outcomes.is_payment_status(c("canonical_status"))),
            ("payment_currency_iso4217_format", ~c("currency").rlike(vocab.CURRENCY_PATTERN)),
        ],
        "sync_metadata": [
            ("sync_metadata_status_valid", ~c("last_sync_status").isin(vocab.RUN_STATUSES)),
            ("sync_metadata_mode_valid", ~c("last_sync_mode").isin(vocab.RUN_MODES)),
        ],
        "job_history": [
            ("job_history_mode_valid", ~c("mode").isin(vocab.RUN_MODES)),
            ("job_history_outcome_valid", ~c("outcome").isin(vocab.RUN_OUTCOMES)),
        ],
        "webhook_events": [
            ("webhook_event_status_valid", ~c("processing_status").isin(vocab.WEBHOOK_STATUSES))
        ],
        "payment_status_mappings": [
            (
                "payment_status_mapping_canonical_valid",
                ~outcomes.is_payment_status(c("canonical_status")),
            )
        ],
        "canonical_record_audit": [
            (
                "canonical_record_audit_operation_valid",
                ~c("operation").isin(vocab.AUDIT_OPERATIONS),
            )
        ],
    }.get(table, [])


def check_constraints(df: DataFrame, table: str) -> DataFrame:
    """Every row with `violations`: the names of the rules it breaks, comma-separated."""
    return df.withColumn("violations", violations(table))


def violations(table: str) -> Column:
    """The names of the table's rules that a row breaks, comma-separated; empty for none."""
    return F.concat_ws(",", *[F.when(broken, name) for name, broken in check_rules(table)])


def enforce(df: DataFrame, table: str) -> DataFrame:
    """The rows as they are; one that breaks a rule of the table fails the job that writes it.

    The check sits in a column rather than a filter, which the optimiser would move to where
    rows that are not written still are.
    """
    if not check_rules(table):
        return df
    broken, first = violations(table), df.schema.fields[0]
    message = F.concat(F.lit(f"{table} violates "), broken)
    checked = F.when(broken == "", F.col(first.name)).otherwise(F.raise_error(message).cast(first.dataType))
    return df.select(checked.alias(first.name), *df.columns[1:])


def quarantine(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows that may be written, and rows that break a rule."""
    checked = check_constraints(df, table)
    return checked.where("violations = ''").drop("violations"), checked.where("violations <> ''")


def unknown_providers(df: DataFrame, providers: DataFrame) -> DataFrame:
    """Rows whose provider is not in the provider table."""
    return df.join(providers.select("provider"), "provider", "left_anti")


def enforce_provider_fk(df: DataFrame, providers: DataFrame) -> DataFrame:
    return df.join(providers.select("provider"), "provider", "left_semi")
