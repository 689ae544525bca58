"""Fixed values.

Everything in this file has to equal what the system being matched uses, or the
results differ: word lists, lookup tables, constants, patterns and texts. They are
plain data; the logic that uses them lives in the other modules. Most operators take
them as default parameters, so a user can pass a table of their own.
"""

# --- levels and labels ---------------------------------------------------------

LEVEL_RANK = {
    "TRACE": 0,
    "DEBUG": 0,
    "INFO": 1,
    "NOTICE": 1,
    "WARN": 2,
    "WARNING": 2,
    "ERROR": 3,
    "ERR": 3,
    "CRITICAL": 4,
    "CRIT": 4,
    "FATAL": 4,
    "EMERGENCY": 4,
    "UNKNOWN": 1,
}
UNKNOWN_LEVEL = "UNKNOWN"

ERROR_LEVELS = ("ERROR", "ERR", "CRITICAL", "CRIT", "FATAL", "EMERGENCY")
WARNING_LEVELS = ("WARN", "WARNING", "NOTICE")

SEVERITIES = ("Critical", "High", "Medium", "Low")
SEVERITY_RANK = {"Critical": 3, "High": 2, "Medium": 1, "Low": 0}
ACTIVE_STATUSES = ("Active", "Investigating", "Monitoring")

# --- JSON field names, in order of preference -------------------------------------

JSON_TS_KEYS = ("timestamp", "time", "ts", "@timestamp", "datetime", "date")
JSON_LEVEL_KEYS = ("level", "severity", "lvl", "loglevel", "log_level")
JSON_SERVICE_KEYS = ("service", "svc", "logger", "component", "app", "source", "unit")
JSON_MESSAGE_KEYS = ("message", "msg", "log", "text", "event", "body")

# --- text line patterns (Python flavour, see functions.regex) ----------------------

TS_PREFIX = (
    r"^\s*(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,6})?(?:Z|[+-]\d{2}:?\d{2})?)\s+"
)
LEVEL_PREFIX = r"^\s*[\[\(]?([A-Za-z]{3,9})[\]\)]?\s+"
SERVICE_PREFIX = r"^\s*([A-Za-z][\w.\-/]{1,40})\s*(?:[-:]\s+|\s+)"

# --- masks, applied in this order (Python flavour) ---------------------------------

MASKS = (
    ("uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    ("ts", r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<TS>"),
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "<EMAIL>"),
    ("url", r"\bhttps?://[^\s\"']+", "<URL>"),
    ("ip", r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "<IP>"),
    ("duration", r"\b\d+(?:\.\d+)?\s?(?:ns|us|ms|s|m|h)\b", "<DUR>"),
    ("size", r"\b\d+(?:\.\d+)?\s?(?:[kKmMgGtT]i?[bB])\b", "<SIZE>"),
    ("hex_prefixed", r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    ("hex_run", r"\b[0-9a-fA-F]{12,}\b", "<HEX>"),
    ("path", r"(?:/[\w.\-]+){2,}/?", "<PATH>"),
    ("quoted", r"\"[^\"]*\"|'[^']*'", "<STR>"),
    ("percent", r"\b\d+(?:\.\d+)?%", "<PCT>"),
    ("number", r"(?<![\w<])[+-]?\d+(?:\.\d+)?(?![\w>])", "<NUM>"),
)

# --- template mining --------------------------------------------------------------

WILDCARD = "<*>"
EMPTY_TOKEN = "<empty>"
MAX_DEPTH = 4
SIM_THRESHOLD = 0.5
MAX_CHILDREN = 100
MAX_EXAMPLES = 8

# --- time buckets: (span up to this many seconds, bucket seconds) -------------------

BUCKET_LADDER = ((30 * 60, 60), (3 * 3600, 300), (24 * 3600, 3600), (7 * 86400, 21600))
WIDEST_BUCKET = 86400
DEFAULT_BUCKET_SECONDS = 300
RECENT_FRACTION = 6
EPSILON = 1e-9
MAX_GROWTH = 9999.0
MIN_GROWTH = -100.0

# --- anomaly ------------------------------------------------------------------------

DEFAULT_SENSITIVITY = 0.6
THRESHOLD_AT_ZERO = 3.5
THRESHOLD_SLOPE = 2.5
MAD_TO_SIGMA = 1.4826
MAX_Z = 10.0
MIN_PEAK_EVENTS = 4
MIN_PEAK_RATIO = 1.5

# --- severity -----------------------------------------------------------------------

SEVERITY_WEIGHTS = {
    "anomaly": 0.30,
    "level": 0.25,
    "criticality": 0.15,
    "volume": 0.15,
    "growth": 0.10,
    "breadth": 0.05,
}
SERVICE_CRITICALITY = {
    "payments-api": 1.0,
    "checkout-gateway": 1.0,
    "auth-service": 0.9,
    "orders-api": 0.85,
    "webhooks": 0.6,
    "analytics-api": 0.5,
    "media-worker": 0.5,
    "edge-cache": 0.45,
    "notifications": 0.4,
}
DEFAULT_CRITICALITY = 0.5
SEVERITY_CUTS = (("Critical", 0.75), ("High", 0.55), ("Medium", 0.35))
LOWEST_SEVERITY = "Low"

# --- incidents ----------------------------------------------------------------------

INCIDENT_BASE = 4800
INCIDENT_MIN_SCORE = 0.35
INCIDENT_MIN_LEVEL_RANK = 2
TITLE_WORDS = 9
TITLE_CHARS = 80
TITLE_STOP_WORDS = (
    "<*>", "<num>", "<str>", "<id>", "<hex>", "<dur>", "<ip>", "<ts>", "<uuid>",
    "<url>", "<path>", "<pct>", "<size>", "<email>", "<empty>",
)

# --- correlation: downstream service -> upstream services ----------------------------

DEPENDENCIES = {
    "checkout-gateway": ("payments-api", "cart-service", "auth-service"),
    "payments-api": ("payments-db", "auth-service"),
    "orders-api": ("payments-api", "orders-db"),
    "webhooks": ("orders-api",),
    "media-worker": ("media-storage",),
    "analytics-api": ("analytics-db",),
}
MAX_LAG_SECONDS = 3600
LEAD_TOLERANCE_SECONDS = 120
TEMPORAL_WINDOW_SECONDS = 180

# --- dashboard ------------------------------------------------------------------------

TOP_CLUSTERS = 5
FREQUENCY_BARS = 8
MAX_INSIGHTS = 4
INSIGHT_MIN_ANOMALY = 0.7
CRITICAL_PENALTY = 12
DEGRADED_PENALTY = 6

# --- root cause rules, in order: (words, cause, three fixes) ----------------------------

ROOT_CAUSE_RULES = (
    (
        ("connection pool", "pool exhausted", "too many connections"),
        "The service exhausted its database connection pool — connections are being acquired faster than they are released (slow queries, a leak, or an undersized pool).",
        (
            "Increase the pool size / max connections and validate DB capacity",
            "Audit for unclosed connections or long-running transactions holding connections",
            "Add acquisition timeouts and circuit breaking to fail fast under saturation",
        ),
    ),
    (
        ("503", "5xx", "upstream", "bad gateway", "returned 500"),
        "Elevated 5xx responses driven by a failing upstream dependency rather than a fault in this service itself.",
        (
            "Confirm the upstream dependency's health and roll back its recent changes",
            "Add retries with backoff and a circuit breaker around the upstream call",
            "Serve cached/degraded responses while the dependency recovers",
        ),
    ),
    (
        ("heap", "oom", "memory", "rss"),
        "Memory pressure consistent with a leak — heap/RSS climbs until the worker approaches out-of-memory.",
        (
            "Capture a heap snapshot and diff allocations to find the retained objects",
            "Cap in-flight work and add back-pressure to bound memory growth",
            "Roll the affected workers and set memory limits with auto-restart",
        ),
    ),
    (
        ("latency", "slo", "timeout", "slow"),
        "Latency has breached its SLO — requests are taking materially longer than the configured threshold.",
        (
            "Profile the hot path and check downstream call latency",
            "Add/inspect timeouts and connection reuse to bound tail latency",
            "Scale out or add caching for the slow operation",
        ),
    ),
    (
        ("duplicate", "idempoten"),
        "Duplicate processing — the same work is being handled more than once, indicating a missing idempotency guard or at-least-once redelivery.",
        (
            "Enforce idempotency keys on the handler and dedupe on delivery id",
            "Verify ack/retry semantics on the producer",
            "Add a short-lived dedupe cache keyed on the event id",
        ),
    ),
    (
        ("query", "index", "rollup"),
        "A slow database query — likely a missing index or an unbounded scan over a large table.",
        (
            "EXPLAIN the query and add the missing index",
            "Bound the scan (pagination / time window) and precompute heavy rollups",
            "Move the workload off the hot path to a background job",
        ),
    ),
    (
        ("cache miss", "cache", "cdn", "hit ratio"),
        "Cache effectiveness dropped — a cold cache or shortened TTL is pushing load to the origin.",
        (
            "Warm the cache and review TTL / invalidation changes",
            "Check for a key-space change that reduced hit ratio",
            "Add stale-while-revalidate to shield the origin",
        ),
    ),
)
DEFAULT_CAUSE = (
    "An abnormal, statistically significant change in this log cluster relative to its baseline."
)
DEFAULT_FIXES = (
    "Inspect the example log lines below for the failing operation",
    "Correlate with recent deploys or config changes on this service",
    "Check downstream dependencies for related errors",
)
MAX_FIXES = 5
EXTERNAL_SOURCE = "gemini"
DETERMINISTIC_SOURCE = "deterministic"
REPORT_BASE = 1000
