"""Fixed values of the data contract.

Everything in this file is a constant that must have exactly this value for
results to be right: column names, schema keys, sample-size gates, tolerances.
"""

# Canonical bar columns (one row per symbol and bar).
BAR_COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume")
PRICE_COLUMNS = ("open", "high", "low", "close")
NUMERIC_COLUMNS = ("open", "high", "low", "close", "volume")

# Raw daily provider columns and the canonical names they map to.
PROVIDER_COLUMNS = {
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Volume": "volume",
}

# Splits a study may read; every other split stays sealed.
ALLOWED_SPLITS = ("train", "validation")

# Parameter neighbourhood, cost scenarios and fixed spot checks.
FAST_PERIODS = (8, 9, 10, 11, 12)
SLOW_PERIODS = (25, 30, 35)
BASELINE_CELL = (10, 30)
SPOT_CHECKS = ((8, 25), (10, 30), (12, 35))
MAX_CELLS = 25
COST_SCENARIOS = {
    "baseline": (0.001, 0.0005),
    "moderately_worse": (0.0025, 0.0015),
    "materially_worse": (0.005, 0.004),
}
INITIAL_CASH = 100_000.0
ISOLATED_CELL_MULTIPLIER = 2.0

# Sample-size gates and annualisation.
PERIODS_PER_YEAR = 252
MIN_RETURNS_FOR_VOLATILITY = 2
MIN_RETURNS_FOR_SHARPE = 60
MIN_TRIPS = 20

# Tolerances.
QUANTITY_TOLERANCE = 1e-9
PRICE_RELATIVE_TOLERANCE = 1e-9
EQUITY_RELATIVE_TOLERANCE = 1e-9
RETURN_ABSOLUTE_TOLERANCE = 1e-9

# Request planning for daily history.
DAY_SECONDS = 86_400
HISTORY_FLOOR = "2015-01-01"
REQUEST_DAYS = 300
MAX_REQUEST_DAYS = 350

# Closed schema of a raw page artifact.
RAW_SCHEMA_VERSION = 1
RAW_PROVIDER = "coinbase"
RAW_INTERVAL = "1d"
RAW_GRANULARITY = "ONE_DAY"
RAW_PRODUCTS = ("ADA-EUR", "DOT-EUR")
ARTIFACT_KEYS = ("schema_version", "provider", "product", "interval", "retrieval", "pages")
RETRIEVAL_KEYS = ("python_version", "sdk_version", "started_at_utc", "completed_at_utc")
PAGE_KEYS = ("request", "rate_limit_headers", "candles")
REQUEST_KEYS = ("product_id", "start", "end", "granularity")
RATE_LIMIT_KEYS = ("x-ratelimit-limit", "x-ratelimit-remaining", "x-ratelimit-reset")
CANDLE_KEYS = ("start", "low", "high", "open", "close", "volume")
CANDLE_NUMERIC = ("low", "high", "open", "close", "volume")

# Experiment registry.
REGISTRY_OLD_COLUMNS = (
    "experiment_id", "date", "git_commit", "hypothesis", "strategy_id",
    "data_start", "data_end", "split", "params", "outcome", "notes",
)
REGISTRY_COLUMNS = (
    "experiment_id", "date", "git_commit", "working_tree_clean", "record_status",
    "hypothesis", "strategy_family_id", "strategy_id", "data_start", "data_end",
    "split", "processed_snapshot_sha256", "source_raw_sha256", "config_sha256",
    "window_ids", "params_json", "cost_scenario", "outcome", "metrics_report_path",
    "dependency_versions_json", "test_evaluated", "test_evaluated_date",
    "test_evaluation_experiment_id", "notes",
)
REGISTRY_REQUIRED = (
    "git_commit", "processed_snapshot_sha256", "source_raw_sha256", "config_sha256",
    "params_json", "cost_scenario", "window_ids", "metrics_report_path",
    "dependency_versions_json",
)
DEPENDENCY_KEYS = ("python", "pandas", "pyarrow", "vectorbt")

# Corporate-action guard: half-open range it may look at.
ACTION_RANGE = ("2010-01-01", "2023-01-01")
