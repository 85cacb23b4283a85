"""The rule pack: every number that decides a verdict, as immutable values."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule weights, tolerances, importances, directions and tiers of the rule pack.
BASE_WEIGHTS = {"R1": 15, "R2": 18, "R3": 12, "R4": 8, "R5": 10, "R6": 6, "R7": 17}
TOLERANCE_PCT = {
    "revenue": 2.0, "arr": 2.0, "mrr": 2.0, "cogs": 2.0, "gross_profit": 2.0, "opex": 2.0, "ebitda": 2.0, "net_profit": 2.0,
    "total_assets": 0.5, "liabilities": 0.5, "equity": 0.5, "cash_position": 1.0, "opening_cash": 0.5, "closing_cash": 0.5,
    "net_cash_flow": 1.0, "burn_rate": 3.0, "cash_runway": 5.0, "customer_base": 1.0, "headcount": 8.0, "valuation": 1.0,
    "pre_money_valuation": 0.5, "post_money_valuation": 0.5, "round_size": 0.5, "tam": 10.0,
}
#: Metrics in reference codes.
ABBREVIATIONS = {
    "revenue": "REV", "arr": "ARR", "mrr": "MRR", "revenue_growth": "GRW", "cogs": "COGS", "gross_profit": "GP", "gross_margin": "GM", "opex": "OPEX",
    "ebitda": "EBITDA", "ebitda_margin": "EBM", "net_profit": "NP", "net_margin": "NM", "depreciation_amortization": "DA", "interest_expense": "INT",
    "tax_expense": "TAX", "total_assets": "ASST", "liabilities": "LIAB", "equity": "EQTY", "cash_position": "CASH", "opening_cash": "OCSH",
    "closing_cash": "CCSH", "net_cash_flow": "NCF", "burn_rate": "BURN", "cash_runway": "RWAY", "customer_base": "CUST", "churn_rate": "CHRN",
    "cac": "CAC", "ltv": "LTV", "ltv_cac_ratio": "LTVC", "ownership": "OWN", "esop_pool": "ESOP", "valuation": "VAL", "pre_money_valuation": "PRE",
    "post_money_valuation": "POST", "round_size": "RND", "headcount": "HC", "revenue_per_employee": "RPE", "tam": "TAM",
}
TOLERANCE_POINTS = {"gross_margin": 0.2, "ebitda_margin": 0.2, "net_margin": 0.2, "revenue_growth": 0.5, "churn_rate": 0.3, "ownership": 0.1, "esop_pool": 0.1}
IMPORTANCE = {
    "revenue": 1.0, "arr": 1.0, "mrr": 0.95, "ebitda": 0.95, "cash_position": 0.95, "closing_cash": 0.95, "opening_cash": 0.85,
    "net_cash_flow": 0.85, "net_profit": 0.9, "gross_profit": 0.85, "cogs": 0.8, "opex": 0.8, "ownership": 0.9, "esop_pool": 0.7,
    "valuation": 0.85, "pre_money_valuation": 0.85, "post_money_valuation": 0.85, "round_size": 0.85, "total_assets": 0.8,
    "liabilities": 0.8, "equity": 0.8, "burn_rate": 0.8, "cash_runway": 0.75, "gross_margin": 0.8, "ebitda_margin": 0.8,
    "net_margin": 0.75, "revenue_growth": 0.7, "customer_base": 0.6, "churn_rate": 0.55, "headcount": 0.35,
    "revenue_per_employee": 0.3, "tam": 0.2,
}
FAVOURABLE_UP = (
    "revenue", "arr", "mrr", "gross_profit", "gross_margin", "ebitda", "ebitda_margin", "net_profit", "net_margin", "cash_position",
    "closing_cash", "cash_runway", "customer_base", "ltv", "ltv_cac_ratio", "revenue_growth", "valuation", "pre_money_valuation",
    "post_money_valuation", "tam", "ownership",
)
FAVOURABLE_DOWN = ("burn_rate", "churn_rate", "cac", "cogs", "opex", "liabilities")
TIERS = {"auditor_notes": 3, "audited_financials": 3, "financial_statements": 2, "mis": 2, "cap_table": 2, "term_sheet": 2}
# Deck categories, parse qualities, bands, flow, growth and margin metrics, pillars.
DECK = ("pitch_deck", "teaser")
PARSE_QUALITY = {"xlsx_cell": 1.0, "parsed_table": 0.9, "prose": 0.75, "ocr": 0.55, "unknown": 0.75}
BANDS = {
    "gross_margin": (-100.0, 100.0), "ebitda_margin": (-1000.0, 100.0), "net_margin": (-1000.0, 100.0), "churn_rate": (0.0, 100.0),
    "ownership": (0.0, 100.0), "esop_pool": (0.0, 100.0), "headcount": (0.0, 1e6), "customer_base": (0.0, 1e10),
    "ltv_cac_ratio": (0.0, 20.0), "cash_runway": (0.0, 120.0), "revenue_per_employee": (1e5, 1e8), "revenue_growth": (-100.0, 10000.0),
}
FLOWS = ("revenue", "cogs", "opex", "net_cash_flow", "ebitda", "net_profit")
GROWTH_METRICS = ("revenue", "arr", "mrr", "gross_profit", "ebitda", "net_profit", "customer_base")
MARGIN_METRICS = ("gross_margin", "ebitda_margin", "net_margin")
# What names a new investor and the option pool among holders.
NEW_INVESTOR = ("new investor", "incoming", "series", "proposed", "this round", "lead investor")
OPTION_POOL = ("esop", "option pool")
PILLARS = {"arithmetic_integrity": (0.25, ("R2", "R3")), "cross_doc_consistency": (0.30, ("R1",)), "evidence_coverage": (0.20, ("R5",)), "projection_credibility": (0.15, ("R4", "R6")), "ownership_integrity": (0.10, ("R7",))}
PILLAR_NAMES = {"arithmetic_integrity": "Arithmetic Integrity", "cross_doc_consistency": "Cross-Document Consistency", "evidence_coverage": "Evidence Coverage", "projection_credibility": "Projection Credibility", "ownership_integrity": "Ownership Integrity"}
BAND_NAMES = {"READY": 85, "CONDITIONAL": 70, "MATERIAL_GAPS": 50, "HIGH_RISK": 0}
#: Documents and kinds of them that a session needs.
LEAST_DOCUMENTS = 2
LEAST_KINDS = 2
# The unit of each metric; those not named are currency.
UNITS = {
    "revenue_growth": "pct", "gross_margin": "pct", "ebitda_margin": "pct", "net_margin": "pct", "churn_rate": "pct", "ownership": "pct",
    "esop_pool": "pct", "customer_base": "count", "headcount": "count", "cash_runway": "months", "ltv_cac_ratio": "ratio",
}
METRICS = (
    "revenue", "arr", "mrr", "revenue_growth", "cogs", "gross_profit", "opex", "ebitda", "depreciation_amortization", "interest_expense",
    "tax_expense", "net_profit", "gross_margin", "ebitda_margin", "net_margin", "total_assets", "liabilities", "equity", "cash_position",
    "opening_cash", "closing_cash", "net_cash_flow", "burn_rate", "cash_runway", "customer_base", "churn_rate", "cac", "ltv",
    "ltv_cac_ratio", "ownership", "esop_pool", "valuation", "pre_money_valuation", "post_money_valuation", "round_size", "headcount",
    "revenue_per_employee", "tam",
)


@dataclass(frozen=True)
class Identity:
    """signed terms for a sum; numerator, denominator and scale for a ratio; operand and factor for a product."""

    id: str
    result: str
    kind: str
    terms: tuple[tuple[int, str], ...]
    scale: float = 1.0
    pct: float | None = None
    points: float | None = None
    derive_only: bool = False


# The accounting identities.
IDENTITIES = (
    Identity("gross_profit", "gross_profit", "linear", ((1, "revenue"), (-1, "cogs")), pct=0.5),
    Identity("ebitda", "ebitda", "linear", ((1, "gross_profit"), (-1, "opex")), pct=0.5),
    Identity("net_profit", "net_profit", "linear", ((1, "ebitda"), (-1, "depreciation_amortization"), (-1, "interest_expense"), (-1, "tax_expense")), pct=0.5),
    Identity("balance_sheet", "total_assets", "linear", ((1, "liabilities"), (1, "equity")), pct=0.1),
    Identity("cash_flow", "closing_cash", "linear", ((1, "opening_cash"), (1, "net_cash_flow")), pct=0.1),
    Identity("closing_cash_is_cash_position", "closing_cash", "linear", ((1, "cash_position"),), pct=1.0),
    Identity("post_money", "post_money_valuation", "linear", ((1, "pre_money_valuation"), (1, "round_size")), pct=0.5),
    Identity("gross_margin_pct", "gross_margin", "ratio", ((1, "gross_profit"), (1, "revenue")), 100, points=0.2),
    Identity("ebitda_margin_pct", "ebitda_margin", "ratio", ((1, "ebitda"), (1, "revenue")), 100, points=0.2),
    Identity("net_margin_pct", "net_margin", "ratio", ((1, "net_profit"), (1, "revenue")), 100, points=0.2),
    Identity("runway", "cash_runway", "ratio", ((1, "cash_position"), (1, "burn_rate")), pct=5.0),
    Identity("ltv_cac", "ltv_cac_ratio", "ratio", ((1, "ltv"), (1, "cac")), pct=2.0),
    Identity("arr_from_mrr", "arr", "product", ((1, "mrr"),), 12, pct=1.0),
    Identity("revenue_per_employee", "revenue_per_employee", "ratio", ((1, "revenue"), (1, "headcount")), pct=2.0, derive_only=True),
)


@dataclass(frozen=True)
class RulePack:
    version: str = "1.0.0"
    base_currency: str = "INR"
    default_pct: float = 2.0
    default_points: float = 0.5
    tolerance_pct: dict = field(default_factory=lambda: dict(TOLERANCE_PCT))
    identities: tuple[Identity, ...] = IDENTITIES
    gate: float = 0.65
    unresolved: float = 2.0
    saturation: float = 40.0
    rollup_pct: float = 0.5
    growth_ratio: float = 3.0
    growth_pct: float = 50.0
    margin_step: float = 10.0
    burn_drop: float = 40.0
    growth_floor: float = 100_000.0
    ownership_points: float = 0.1
    #: Settings of sessions that go before these numbers, as a table (see settings.py).
    own: DataFrame | None = field(default=None, compare=False)

    def with_tolerance(self, metric: str, pct: float) -> "RulePack":
        """A copy in which a metric has another tolerance; nothing is changed in place."""
        return replace(self, tolerance_pct=self.tolerance_pct | {metric: pct})

    def with_settings(self, own: DataFrame) -> "RulePack":
        """A copy in which sessions have settings of their own."""
        return replace(self, own=own)


def looked_up(key: Column, table: dict, kind: str = "double") -> Column:
    """The table's value for a key, null without one; the table is a literal of the plan."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key].cast(kind)


def unit_of(metric: Column) -> Column:
    return F.coalesce(looked_up(metric, UNITS, "string"), F.when(metric.isin(*METRICS), "currency"))
