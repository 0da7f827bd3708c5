"""Column layout parameters and the fixed values of the risk definitions."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Codes, thresholds, identifiers and names that results must equal.
# ---------------------------------------------------------------------------
DEFINITION_VERSION = "0.1.0"
MODEL_DEFINITION_VERSION = "0.2.0"
SPLIT_VERSION = "customer_sha256_v1"
OBSERVATION_DATE = "2005-09-30"

SIGNALS = (
    "recent_max_delinquency",
    "delinquent_months_6m",
    "delinquency_deterioration",
    "latest_utilization_ratio",
    "payment_coverage_ratio",
    "zero_payment_streak",
    "recent_bill_growth",
)
STATIC_NUMERIC = ("log_credit_limit", "age_years")
STATIC_CATEGORICAL = ("sex_code", "education_code", "marriage_code")
BEHAVIORAL_NUMERIC = SIGNALS
MODELS = ("static", "behavioral", "combined")
NEVER_FEATURES = frozenset(
    {
        "customer_id",
        "next_month_default",
        "observation_date",
        "source_id",
        "source_file_sha256",
        "definition_version",
        "pipeline_run_id",
        "risk_points",
        "risk_band",
    }
)
SEGMENT_FIELDS = ("sex_code", "education_code", "marriage_code", "age_band", "risk_band")
SPLITS = ("train", "calibration", "test")

SEX_CODES = (1, 2)
EDUCATION_CODES = (1, 2, 3, 4)
MARRIAGE_CODES = (1, 2, 3)
STATUS_CODES = (-1, 1, 2, 3, 4, 5, 6, 7, 8, 9)
AGE_BOUNDS = (18, 120)
INT32_MIN, INT32_MAX = -2147483648, 2147483647

MINIMUM_TESTS = 12
MINIMUM_SIGNALS = 5
AMOUNT_TOLERANCE = 0.01
METRIC_TOLERANCE = 1e-10
CALIBRATION_TOLERANCE = 1e-6
PROBABILITY_EPSILON = 1e-12
CALIBRATION_BINS = 10

ENFORCED_TESTS = tuple(f"DQ-{n:03d}" for n in range(1, 16))

GRAPH_SCOPES = ("economic_transmission", "data_lineage")
NODE_TYPES = (
    "Problem", "Decision", "Constraint", "Shock", "Agent", "Incentive", "Behavior",
    "Source", "Field", "Table", "Transformation", "Query", "Feature", "RiskComponent",
    "Scenario", "Metric", "Test", "Result", "Artifact", "Run", "Version", "Issue",
    "Owner", "Approval", "DecisionRecord", "Checkpoint",
)
EDGE_TYPES = (
    "causes", "amplifies", "mitigates", "observed_by", "constrained_by", "computed_from",
    "transformed_by", "validated_by", "fails", "explains", "supports", "reported_in",
    "owned_by", "supersedes", "requires_approval",
)
EDGE_SIGNS = ("positive", "negative", "mixed", "unknown")

# Expected ex-ante direction of the outcome rate along each signal.
EXPECTED_SIGNS = {
    "recent_max_delinquency": "positive",
    "delinquent_months_6m": "positive",
    "delinquency_deterioration": "positive",
    "latest_utilization_ratio": "positive",
    "payment_coverage_ratio": "negative",
    "zero_payment_streak": "positive",
    "recent_bill_growth": "positive",
}
# The three buckets compared, lowest exposure first.
DIRECTION_BUCKETS = {
    "recent_max_delinquency": ("0", "1", "2+"),
    "delinquent_months_6m": ("0", "1", "2+"),
    "delinquency_deterioration": ("<=0", "1", "2+"),
    "latest_utilization_ratio": ("<0.80", "0.80-<1.00", ">=1.00"),
    "payment_coverage_ratio": ("<0.10", "0.10-<0.50", ">=0.50"),
    "zero_payment_streak": ("0", "1", "2+"),
    "recent_bill_growth": ("<=0", "0-<0.25", ">=0.25"),
}

REQUIRED_CHECKS = {
    1: ("source_registered", "sha256_recorded", "source_shape_recorded", "raw_rows_reconciled"),
    2: (
        "primary_key", "foreign_key", "wide_to_long_rows", "bill_amounts",
        "payment_amounts", "code_domains", "sql_test_suite",
    ),
    3: (
        "signal_count", "definition_version", "observation_timing", "leakage",
        "outcome_summary", "sql_reproducibility",
    ),
    4: ("time_validation", "calibration", "segment_stability", "sensitivity_direction", "proxy_labels"),
    5: ("shared_run_id", "cross_artifact_values", "limitations", "evidence_map"),
}
BLOCKING_ISSUES = ("time_direction_unavailable", "sensitivity_unavailable")
RUN_ID_PATTERN = r"[A-Za-z0-9][A-Za-z0-9._:-]{2,127}"
SHA256_PATTERN = "^[0-9a-f]{64}$"


# ---------------------------------------------------------------------------
# Parameters
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Period:
    """One history period of a wide row: its offset and its three measures."""

    offset: int
    status: str
    bill: str
    payment: str


# Period offsets and the wide columns that hold them.
WIDE_PERIODS = (
    Period(0, "pay_0", "bill_amt1", "pay_amt1"),
    Period(-1, "pay_2", "bill_amt2", "pay_amt2"),
    Period(-2, "pay_3", "bill_amt3", "pay_amt3"),
    Period(-3, "pay_4", "bill_amt4", "pay_amt4"),
    Period(-4, "pay_5", "bill_amt5", "pay_amt5"),
    Period(-5, "pay_6", "bill_amt6", "pay_amt6"),
)


@dataclass(frozen=True)
class PanelParams:
    """Names that bind the operators to one source table.

    ``attributes`` maps wide columns to borrower columns. The panel and
    borrower tables themselves always carry the canonical names.
    """

    run_id: str = "RUN-001"
    wide_key: str = "id"
    wide_outcome: str = "default_payment_next_month"
    attributes: tuple[tuple[str, str], ...] = (
        ("limit_bal", "credit_limit_ntd"),
        ("sex", "sex_code"),
        ("education", "education_code"),
        ("marriage", "marriage_code"),
        ("age", "age_years"),
    )
    periods: tuple[Period, ...] = WIDE_PERIODS
    observation_date: str = OBSERVATION_DATE
    definition_version: str = DEFINITION_VERSION
    recent: tuple[int, int] = field(default=(-2, 0))
    earlier: tuple[int, int] = field(default=(-5, -3))

    @property
    def n_periods(self) -> int:
        return len(self.periods)

    @property
    def offsets(self) -> tuple[int, ...]:
        """Period offsets, oldest first."""
        return tuple(sorted(p.offset for p in self.periods))

    @property
    def wide_measures(self) -> list[str]:
        return [c for p in self.periods for c in (p.status, p.bill, p.payment)]


DEFAULT = PanelParams()
