"""What a source is: its payload schema, its rules and where its watermark sits."""

from __future__ import annotations

import calendar
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F, types as T

from revsync import schemas, vocab
from revsync.functions import times
from revsync.operators import filters, normalize, validate
from revsync.sources import landing


@dataclass(frozen=True)
class SourceSpec:
    provider: str
    entity_type: str
    payload: T.StructType
    table: T.StructType
    normalize: Callable[..., DataFrame]
    rules: Callable[[], list[validate.Rule]]
    # The payload's modification time, and how a cursor token is written for it.
    watermark: Callable[[], Column]
    token: Callable[[Column], Column]
    # The time a token stands for.
    token_time: Callable[[Column], Column]
    empty_token: str
    needs_status_map: bool = False
    # The same bound as `watermark() >= since`, on a column as it is stored, so that a scan
    # can skip what is older.
    stored_bound: Callable[[datetime], Column] | None = None

    def changed_since(
        self, landed: DataFrame, since: datetime, skew: timedelta = timedelta(days=1)
    ) -> DataFrame:
        """Landed payloads modified at `since` or later.

        A payload lands after it was modified, so that what landed before is not even read;
        `skew` is how far the provider's clock may be ahead of the one that dates files.
        """
        scan = landing.landed_since(landed, since - skew)
        if self.stored_bound:
            scan = scan.where(self.stored_bound(since))
        return filters.watermark_filter(scan, self.watermark(), times.at(since))

    @property
    def key(self) -> tuple[str, str]:
        return (self.provider, self.entity_type)


class Registry:
    """Sources by (provider, entity type); each may be registered once."""

    def __init__(self, specs: list[SourceSpec] | None = None):
        self._specs: dict[tuple[str, str], SourceSpec] = {}
        for spec in specs or []:
            self.register(spec)

    def register(self, spec: SourceSpec) -> None:
        if spec.key in self._specs:
            raise ValueError(f"source {spec.key} is already registered")
        self._specs[spec.key] = spec

    def get(self, provider: str, entity_type: str) -> SourceSpec | None:
        return self._specs.get((provider, entity_type))

    def all(self) -> list[SourceSpec]:
        return list(self._specs.values())

    def select(
        self, provider: str | None = None, entity_type: str | None = None
    ) -> list[SourceSpec]:
        """Sources matching the given names; asking for one that is not there is an error."""
        found = [
            s
            for s in self.all()
            if provider in (None, s.provider) and entity_type in (None, s.entity_type)
        ]
        if not found:
            raise ValueError(f"no source registered for {provider}/{entity_type}")
        return found

    def is_configured(self, provider: Column, entity_type: Column) -> Column:
        known = F.lit(False)
        for p, e in self._specs:
            known = known | ((provider == p) & (entity_type == e))
        return known


def _iso_source(**kw) -> SourceSpec:
    return SourceSpec(
        token=times.to_iso, token_time=times.iso_ts, empty_token="1970-01-01T00:00:00.000Z", **kw
    )


CONTACTS = _iso_source(
    provider=vocab.HUBSPOT,
    entity_type=vocab.CONTACT,
    payload=schemas.CONTACT_OBJECT,
    table=schemas.CONTACTS,
    normalize=normalize.normalize_contacts,
    rules=validate.contact_rules,
    watermark=lambda: times.iso_ts(F.col("properties")["lastmodifieddate"]),
)
DEALS = _iso_source(
    provider=vocab.HUBSPOT,
    entity_type=vocab.DEAL,
    payload=schemas.DEAL_OBJECT,
    table=schemas.DEALS,
    normalize=normalize.normalize_deals,
    rules=validate.deal_rules,
    watermark=lambda: times.iso_ts(F.col("properties")["hs_lastmodifieddate"]),
)
CALENDAR = _iso_source(
    provider=vocab.GOOGLE_CALENDAR,
    entity_type=vocab.EVENT,
    payload=schemas.CALENDAR_EVENT,
    table=schemas.EVENTS,
    normalize=normalize.normalize_calendar,
    rules=validate.event_rules,
    watermark=lambda: times.iso_ts(F.col("updated")),
)
PAYMENTS = SourceSpec(
    provider=vocab.STRIPE,
    entity_type=vocab.PAYMENT,
    payload=schemas.PAYMENT_INTENT,
    table=schemas.PAYMENTS,
    normalize=normalize.normalize_payments,
    rules=validate.payment_rules,
    watermark=lambda: times.unix_ts(F.col("created")),
    token=lambda ts: times.unix_seconds(ts).cast("string"),
    token_time=lambda token: times.unix_ts(token.cast("bigint")),
    empty_token="0",
    needs_status_map=True,
    stored_bound=lambda since: F.col("created") >= calendar.timegm(since.timetuple()),
)


def default_registry() -> Registry:
    return Registry([CONTACTS, DEALS, CALENDAR, PAYMENTS])
