"""One frozen configuration object holding every threshold of the pipeline.

All DataFrame builders take a ``Config`` so the same plan can be rebuilt
for another SLA, window or cutoff without touching code.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    # --- statuses read by the logic ---
    excluded_status: str = "Cancelled"
    returned_status: str = "Returned"

    # --- Gold ---
    on_time_sla_days: int = 7          # fulfillment_metrics on-time rule
    explorer_sla_days: int = 5         # explorer text / action thresholds (a different number on purpose)
    dead_stock_days: int = 365
    reorder_days_of_supply: int = 14
    recent_session_days: int = 30      # Gold: datediff(ref, created_at) <= 30

    # --- features / labels ---
    prediction_window_days: int = 90
    lookback_days: int = 30            # features: created_at >= cutoff - 30
    recency_fill_multiplier: int = 4   # days_since_last_session fill = 4 x window
    feature_version: str = "v1"
    feature_ttl_days: int = 365        # as-of retrieval TTL

    # --- signals / findings ---
    critical_threshold: float = 0.10
    warning_threshold: float = 0.05
    flat_band: float = 0.005
    churn_high_risk: float = 0.7
    dead_stock_warning_rate: float = 0.10
    churn_warning_share: float = 0.5
    signal_as_of: str | None = None    # 'YYYY-MM-01' to pin the current period

    # --- model / monitoring ---
    drift_threshold: float = 0.1
    auc_drop_threshold: float = 0.05
    decision_threshold: float = 0.5
    split_seed: int = 42
    test_fraction: float = 0.2
    sample_size: int = 1000
    batch_size: int | None = None      # customers in a scored batch; None: all

    # --- sinks ---
    table_format: str = "parquet"

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)


DEFAULT = Config()

# The driver fixture: events live in January 2024 while orders end in 2001;
# shifting events by this many days lets them straddle the feature cutoff.
FIXTURE_EVENT_SHIFT_DAYS = 8293
FIXTURE_SIGNAL_AS_OF = "2001-05-01"
