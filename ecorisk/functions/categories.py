"""Risk categories, criterion ids, estimates and the threshold table."""

from __future__ import annotations

import hashlib
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, name and published colour in order of risk.
CATEGORIES = [
    ("CO", "Collapsed", (0, 0, 0)),
    ("CR", "Critically Endangered", (255, 0, 0)),
    ("EN", "Endangered", (255, 165, 0)),
    ("VU", "Vulnerable", (255, 255, 0)),
    ("NT", "Near Threatened", (173, 255, 47)),
    ("LC", "Least Concern", (0, 128, 0)),
    ("DD", "Data Deficient", (128, 128, 128)),
    ("NE", "Not Evaluated", (255, 255, 255)),
]
# Sub-criteria in report order.
CRITERIA = ["A1", "A2a", "A2b", "A3", "B1", "B2", "B3", "C1", "C2a", "C2b", "C3", "D1", "D2a", "D2b", "D3", "E"]
RANK = {code: k for k, (code, _, _) in enumerate(CATEGORIES)}

TOML = Path(__file__).parents[1].joinpath("thresholds.toml").read_bytes()
SHA256 = hashlib.sha256(TOML).hexdigest()


def thresholds(version: str = "2.0") -> dict:
    """The threshold table of a guidelines version."""
    table = tomllib.loads(TOML.decode())
    if version != table["guidelines_version"]:
        raise ValueError(f"no thresholds for guidelines version {version}; there is {table['guidelines_version']}")
    return table


RULES = {c["id"]: c for c in thresholds()["criterion"]}


def rule(criterion: str) -> dict:
    if criterion not in RULES:
        raise ValueError(f"no threshold table for {criterion}")
    return RULES[criterion]


def category_table(spark: SparkSession) -> DataFrame:
    rows = [(k, code, name, *rgb, k <= RANK["VU"]) for k, (code, name, rgb) in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "rank int, code string, name string, red int, green int, blue int, is_threatened boolean")


def criterion_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c, c[0]) for k, c in enumerate(CRITERIA)], "position int, code string, parent string")


def threshold_table(spark: SparkSession) -> DataFrame:
    rows = [(c, b["category"], float(b["max"]), None) for c, r in RULES.items() for b in r["breakpoints"]]
    rows += [(c, b["category"], None, b["max_locations"]) for c, r in RULES.items() for b in r["location_bounds"]]
    return spark.createDataFrame(rows, "criterion string, category string, max_metric double, max_locations int")


def parse_category(text: str) -> str:
    if text.strip().upper() not in RANK:
        raise ValueError(f"no category {text!r}")
    return text.strip().upper()


def parse_criterion(text: str) -> str:
    for c in CRITERIA:
        if c.upper() == text.strip().upper():
            return c
    raise ValueError(f"no criterion {text!r}")


def code_of(rank: Column) -> Column:
    """Category code of a rank."""
    return F.element_at(F.array(*[F.lit(c[0]) for c in CATEGORIES]), rank + 1)


def classify(criterion: str, value: Column) -> Column:
    """Rank of a metric: the first breakpoint that it doesn't exceed. Null and NaN are not evaluated."""
    r = rule(criterion)
    out = F.lit(RANK[r["above_all"]])
    for b in reversed(r["breakpoints"]):
        out = F.when(value <= float(b["max"]), RANK[b["category"]]).otherwise(out)
    return F.when(value.isNull() | F.isnan(value), RANK["NE"]).otherwise(out)


def estimate(best: Column, lower: Column, upper: Column) -> Column:
    """STRUCT<best, lower, upper>: bounds count only if both are given, and are put in order."""
    both = lower.isNotNull() & upper.isNotNull()
    return F.struct(best.alias("best"), F.when(both, F.least(lower, upper)).otherwise(best).alias("lower"), F.when(both, F.greatest(lower, upper)).otherwise(best).alias("upper"))


def span(best: Column, one: Column, other: Column) -> Column:
    """STRUCT<best, least, most> of ranks: `least` threatened is the larger rank."""
    return F.struct(best.alias("best"), F.greatest(one, other).alias("least"), F.least(one, other).alias("most"))


def classify_estimate(criterion: str, e: Column) -> Column:
    """Range of an estimate's categories."""
    return span(classify(criterion, e["best"]), classify(criterion, e["lower"]), classify(criterion, e["upper"]))


def display(r: Column) -> Column:
    """`X`, or `X (LEAST-MOST)` where the bounds differ."""
    return F.when(r["least"] == r["most"], code_of(r["best"])).otherwise(F.concat(code_of(r["best"]), F.lit(" ("), code_of(r["least"]), F.lit("-"), code_of(r["most"]), F.lit(")")))


def classify_sql(criterion: str, value: str) -> str:
    """classify() as SQL text over an expression."""
    r = rule(criterion)
    cases = " ".join(f"WHEN {value} <= {float(b['max'])!r}D THEN {RANK[b['category']]}" for b in r["breakpoints"])
    return f"CASE WHEN {value} IS NULL OR isnan({value}) THEN {RANK['NE']} {cases} ELSE {RANK[r['above_all']]} END"


def code_sql(rank: str) -> str:
    """code_of() as SQL text: all codes have two letters."""
    return f"substr('{''.join(c[0] for c in CATEGORIES)}', ({rank}) * 2 + 1, 2)"


def display_sql(r: str) -> str:
    """display() as SQL text over columns <r>_best, <r>_least and <r>_most."""
    return f"CASE WHEN {r}_least = {r}_most THEN {code_sql(r + '_best')} ELSE concat({code_sql(r + '_best')}, ' (', {code_sql(r + '_least')}, '-', {code_sql(r + '_most')}, ')') END"


def most_threatened_sql(ranges: list[str], bound: str) -> str:
    """SQL text of one bound of the overall range of columns <r>_best, <r>_least, <r>_most: those not evaluated are left
    out, and data deficient ones too if any other is there."""
    low = ", ".join(f"IF({r}_best < {RANK['DD']}, {r}_{bound}, {RANK['NE']})" for r in ranges)
    best = ", ".join(f"{r}_best" for r in ranges)
    return f"CASE WHEN least({best}) < {RANK['DD']} THEN least({low}) ELSE least({best}) END"
