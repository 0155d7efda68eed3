"""Vocabularies, default words, messages and limits.

Everything here has to be exactly these words or numbers for results to agree
with the system being replaced, so they are kept together as plain text.
"""

# Providers, and the kind of system each one is.
HUBSPOT = "hubspot"
GOOGLE_CALENDAR = "google_calendar"
STRIPE = "stripe"
PROVIDER_SOURCE_SYSTEM = {
    HUBSPOT: "crm",
    GOOGLE_CALENDAR: "calendar",
    STRIPE: "payments",
}
PROVIDER_DISPLAY_NAME = {
    HUBSPOT: "HubSpot",
    GOOGLE_CALENDAR: "Google Calendar",
    STRIPE: "Stripe",
}
PROVIDERS = list(PROVIDER_SOURCE_SYSTEM)
SOURCE_SYSTEMS = ["crm", "payments", "calendar"]

# Entity types.
CONTACT = "contact"
DEAL = "deal"
EVENT = "event"
PAYMENT = "payment"
ENTITY_TYPES = [CONTACT, DEAL, EVENT, PAYMENT]

# Payment statuses. Which of them count as revenue is revenue.py's business alone.
UNKNOWN = "unknown"
PAYMENT_STATUSES = ["collected", "pending", "failed", "refunded", "cancelled", UNKNOWN]

# Calendar event statuses.
EVENT_STATUSES = ["confirmed", "tentative", "cancelled"]

# Runs.
SUCCESS = "success"
PARTIAL_FAILURE = "partial_failure"
FAILED = "failed"
IN_PROGRESS = "in_progress"
RUN_STATUSES = [SUCCESS, PARTIAL_FAILURE, FAILED, IN_PROGRESS]
RUN_OUTCOMES = [SUCCESS, PARTIAL_FAILURE, FAILED]
INCREMENTAL = "incremental"
FULL = "full"
RUN_MODES = [INCREMENTAL, FULL]

# Webhook deliveries.
RECEIVED = "received"
PROCESSED = "processed"
WEBHOOK_STATUSES = [RECEIVED, PROCESSED, FAILED]
DUPLICATE_SKIPPED = "duplicate_skipped"

# Upserts and the audit trail.
CREATED = "created"
UPDATED = "updated"
UNCHANGED = "unchanged"
AUDIT_OPERATIONS = [CREATED, UPDATED]

# Revenue granularities.
GRANULARITIES = ["total", "day", "week", "month"]

# Error codes.
MALFORMED_RESPONSE = "MALFORMED_RESPONSE"
AUTHENTICATION_EXPIRED = "AUTHENTICATION_EXPIRED"
INVALID_CURSOR = "INVALID_CURSOR"
STALE_CURSOR = "STALE_CURSOR"
RATE_LIMITED = "RATE_LIMITED"
PROVIDER_UNAVAILABLE = "PROVIDER_UNAVAILABLE"
PROVIDER_TIMEOUT = "PROVIDER_TIMEOUT"
PROVIDER_NOT_CONFIGURED = "PROVIDER_NOT_CONFIGURED"
RETRYABLE_CODES = [RATE_LIMITED, PROVIDER_TIMEOUT, PROVIDER_UNAVAILABLE]
FULL_RESYNC_CODES = [STALE_CURSOR, INVALID_CURSOR]
FATAL_CODES = [AUTHENTICATION_EXPIRED]

# Properties kept from CRM payloads.
CONTACT_PROPERTIES = [
    "email",
    "firstname",
    "lastname",
    "phone",
    "company",
    "lifecyclestage",
    "createdate",
    "lastmodifieddate",
]
DEAL_PROPERTIES = [
    "dealname",
    "dealstage",
    "amount",
    "pipeline",
    "closedate",
    "createdate",
    "hs_lastmodifieddate",
]

# Words used where a payload says nothing.
UNTITLED_DEAL = "(untitled deal)"
UNKNOWN_STAGE = "unknown"
NO_TITLE = "(no title)"
DEFAULT_EVENT_STATUS = "confirmed"
DEAL_CURRENCY = "USD"

# Validation patterns and messages.
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"
CURRENCY_PATTERN = r"^[A-Z]{3}\z"
SOURCE_ID_REQUIRED = "sourceId is required"
EMAIL_INVALID = "email is not a valid address"
EVENT_STATUS_UNRECOGNIZED = 'unrecognized event status "%s"'
EVENT_NO_TIMES = "event has no usable start/end/originalStartTime"
EVENT_END_BEFORE_START = "end must not be before start"
AMOUNT_NOT_INTEGER = "Money.amountMinor must be an integer, got %s"
AMOUNT_NEGATIVE = "Money.amountMinor must be >= 0, got %s"
CURRENCY_INVALID = 'Money.currency must be an ISO-4217 code, got "%s"'
PAYMENT_AMOUNT_NEGATIVE = "amount must be non-negative"
NOT_CONFIGURED = (
    "Webhook received for %s/%s but that provider is not configured "
    '(missing credentials); event for "%s" was acknowledged but not persisted'
)

# Words for a missing number or a missing text inside a message or a key.
NOT_A_NUMBER = "NaN"
NULL = "null"
UNDEFINED = "undefined"

# Names of the CHECK rules on the tables.
CHECK_RULES = [
    "provider_source_system_valid",
    "deal_amount_non_negative",
    "event_status_valid",
    "event_end_after_start",
    "payment_amount_non_negative",
    "payment_canonical_status_valid",
    "payment_currency_iso4217_format",
    "sync_metadata_status_valid",
    "sync_metadata_mode_valid",
    "job_history_mode_valid",
    "job_history_outcome_valid",
    "webhook_event_status_valid",
    "payment_status_mapping_canonical_valid",
    "canonical_record_audit_operation_valid",
]

# Webhook event type prefixes.
PAYMENT_INTENT_PREFIX = "payment_intent."
CONTACT_PREFIX = "contact."
DEAL_PREFIX = "deal."
HANDSHAKE_STATE = "sync"

# Times and limits.
REPLAY_WINDOW_MS = 5 * 60 * 1000
CURSOR_MAX_AGE_HOURS = 24
DEFAULT_RANGE_DAYS = 30
DEFAULT_REPORT_LIMIT = 50
MAX_REPORT_LIMIT = 500
DURATION_BUCKETS = [0.1, 0.5, 1, 5, 15, 30, 60, 120, 300, 900]

# Seed of the payment status mapping.
STATUS_MAPPING_SEED = [
    (STRIPE, "succeeded", "collected"),
    (STRIPE, "processing", "pending"),
    (STRIPE, "requires_payment_method", "pending"),
    (STRIPE, "requires_action", "pending"),
    (STRIPE, "requires_confirmation", "pending"),
    (STRIPE, "requires_capture", "pending"),
    (STRIPE, "canceled", "cancelled"),
]

# What counts as white space at the ends of a text.
WHITESPACE = (
    " \t\n\u000b\f\r\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

#: The rule that a row's provider exists, and how a reject tells the rules it breaks.
PROVIDER_EXISTS = "provider_exists"
VIOLATES = "Violates: "
