"""Column specs, thresholds and the fixed values the results depend on.

Operators never hard-code column names: they take a :class:`FeatureSpec` (or plain
column lists). The defaults are collected here as plain fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (results depend on these exact values)
# ---------------------------------------------------------------------------

# Target label <-> class id of the three-class problem.
CLASS_LABELS = {0: "low", 1: "medium", 2: "high"}

# First-match-wins bucketing of the raw score: <=5 low, ==6 medium, >=7 high.
DEFAULT_LABEL_RULES = (("<=", 5.0, "low"), ("==", 6.0, "medium"), (">=", 7.0, "high"))

# Column names treated as targets, never as drift features.
TARGET_NAMES = ("quality", "quality_class", "quality_category", "quality_label", "target", "label")

# Candidate target names searched in order when reading a split.
TARGET_CANDIDATES = ("quality_class", "quality_category", "quality_label", "target", "label", "quality")

# Default latency histogram bounds (seconds) of the request-duration histogram, then +Inf.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)

# Numeric text accepted by coercion; everything else (incl. "NaN", "inf", "1d") becomes NULL.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Canonical UUID text.
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


@dataclass(frozen=True)
class AlertRule:
    name: str
    metric: str
    op: str            # one of == != < <= > >=
    threshold: float
    for_seconds: int
    severity: str


# Alert rules: metric, comparison, threshold, hold time, severity.
DEFAULT_ALERT_RULES = (
    AlertRule("ApiDown", "up", "==", 0.0, 60, "critical"),
    AlertRule("ApiHighErrorRate", "error_ratio", ">", 0.05, 300, "warning"),
    AlertRule("ApiHighLatency", "latency_p95_seconds", ">", 2.0, 300, "warning"),
    AlertRule("ModelNotLoaded", "model_loaded", "==", 0.0, 60, "critical"),
    AlertRule("DataDrift", "data_drift_detected", "==", 1.0, 600, "warning"),
    AlertRule("PerformanceDegraded", "model_rolling_accuracy", "<", 0.55, 1800, "warning"),
    AlertRule("ProbeFailed", "probe_success", "==", 0.0, 120, "critical"),
)

# Rule evaluation step and rate range, seconds.
EVAL_STEP_SECONDS = 15
RATE_RANGE_SECONDS = 300


@dataclass(frozen=True)
class SplitConfig:
    test_size: float = 0.15
    validation_size: float = 0.15
    seed: int = 42


@dataclass(frozen=True)
class DriftConfig:
    alpha: float = 0.05
    minimum_statistic: float = 0.10
    detection_ratio: float = 0.30
    minimum_samples: int = 100
    sample_limit: int | None = None   # newest rows of the window; None: all of them
    lookback_days: int = 30
    uncertain_band: float = 0.20   # flag p within +-20 % of alpha/k


@dataclass(frozen=True)
class PerformanceConfig:
    limit: int | None = None          # newest labelled events; None: all of them
    minimum_feedbacks: int = 50
    minimum_accuracy: float = 0.55


@dataclass(frozen=True)
class PreparationConfig:
    iqr_multiplier: float = 1.5
    scaling: str = "standard"      # standard | minmax | none
    split: SplitConfig = field(default_factory=SplitConfig)


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns are features, which is the target, which identify a row."""

    features: tuple[str, ...]
    target: str | None = None
    key: tuple[str, ...] = ()
    labels: tuple[int, ...] = (0, 1, 2)

    def with_features(self, features) -> "FeatureSpec":
        return FeatureSpec(tuple(features), self.target, self.key, self.labels)
