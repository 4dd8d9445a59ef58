"""Criterion B over many ecosystems at a time, as expressions: no shuffle, no Python.

Input columns: eoo_km2, eoo_lower, eoo_upper, aoo_cells, aoo_lower, aoo_upper (DOUBLE, nullable), a_i, a_ii, a_iii, b,
b3_rapid_collapse (met, not_met, not_assessed; null is not_assessed), locations_kind (count, no_plausible_threats,
insufficient_information, not_assessed) and locations (INT). Those that a table lacks count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ecorisk import __version__
from ecorisk.functions.categories import CATEGORIES, RANK, SHA256, classify_sql, code_sql, display_sql, most_threatened_sql, rule, thresholds

METRICS = ("eoo_km2", "eoo_lower", "eoo_upper", "aoo_cells", "aoo_lower", "aoo_upper")
STATUSES = ("a_i", "a_ii", "a_iii", "b", "b3_rapid_collapse")
LEVELS = ("CR", "EN", "VU")
# Location counts up to which Near Threatened may apply.
NT_TRIGGER = {"B1": 9, "B2": 9, "B3": 4}
# Names of the aspects of continuing decline.
ASPECTS = {"i": "a_i", "spatial_extent": "a_i", "ii": "a_ii", "environmental_quality": "a_ii", "iii": "a_iii", "biotic_interactions": "a_iii"}
# The sentences of notes.
NOTES = {
    "metric_above_all_thresholds": "the metric exceeds every threshold, so this criterion is not triggered",
    "metric_missing": "no metric was supplied, so this criterion could not be evaluated",
    "subconditions_refuted": "every sub-condition was assessed and none is met, so this criterion is not triggered",
    "locations_insufficient_information": "threats exist but the number of threat-defined locations could not be assessed, so this sub-criterion is Data Deficient",
    "b3_not_assessed": "B3 requires both very few threat-defined locations and capability of rapid collapse; at least one limb is unassessed",
}
NOTE = "struct<kind:string,pending:array<string>,locations:int,max_locations:int>"


# SQL text over a completed frame. Clause (a) is met if any aspect is, and not met if none can be.
A_MET = "(a_i = 'met' OR a_ii = 'met' OR a_iii = 'met')"
A_OPEN = f"(NOT {A_MET} AND NOT (a_i = 'not_met' AND a_ii = 'not_met' AND a_iii = 'not_met'))"
OPEN = f"({A_OPEN} OR b = 'not_assessed' OR locations_kind IN ('insufficient_information', 'not_assessed'))"
PENDING = {"a": A_OPEN, "b": "b = 'not_assessed'", "c": "locations_kind = 'not_assessed'"}
LETTERS = "array_compact(array(" + ", ".join(f"IF({when}, '{k}', NULL)" for k, when in PENDING.items()) + "))"


def max_locations(criterion: str, level: str) -> int | None:
    return next((b["max_locations"] for b in rule(criterion)["location_bounds"] if b["category"] == level), None)


def _met(criterion: str, level: str) -> str:
    bound = max_locations(criterion, level)
    few = f" OR (locations_kind = 'count' AND locations <= {bound})" if bound is not None else ""
    return f"({A_MET} OR b = 'met'{few})"


def metric_meets(criterion: str, level: str, value: str) -> str:
    """Whether a breakpoint of that level holds the value; true if the criterion has no breakpoints."""
    bounds = rule(criterion)["breakpoints"]
    own = [f"{value} <= {float(b['max'])!r}D" for b in bounds if b["category"] == level]
    return "true" if not bounds else f"({' OR '.join(own) or 'false'})"


def gate_at(criterion: str, level: str) -> tuple[Column, Column]:
    """(met, unknown) of the sub-conditions at a level."""
    met = _met(criterion, level)
    return F.expr(met), F.expr(f"NOT {met} AND {OPEN}")


def level_reached(criterion: str, value: str, optimistic: bool) -> str:
    """Rank of the first level whose metric and gate hold; an unknown gate counts as met unless optimistic."""
    gates = {level: f"_met_{criterion}_{level}" + ("" if optimistic else " OR _open") for level in LEVELS}
    cases = " ".join(f"WHEN {metric_meets(criterion, level, value)} AND ({gates[level]}) THEN {RANK[level]}" for level in LEVELS)
    return f"CASE {cases} ELSE {RANK['LC']} END"


def pending() -> Column:
    """Letters of the clauses that are not assessed."""
    return F.expr(LETTERS)


def _spatial(criterion: str, best: str) -> list[dict[str, str]]:
    """Columns of B1 or B2 in three steps: threshold range _t_ and levels _l_, the case, the range _r_. The order of the
    cases is part of the rule."""
    c, ne, dd, lc = criterion, RANK["NE"], RANK["DD"], RANK["LC"]
    e = {"best": best, "lower": f"_lower_{c}", "upper": f"_upper_{c}"}
    first = {f"_t_{c}_{k}": classify_sql(c, v) for k, v in e.items()}
    first |= {f"_l_{c}_{k}": level_reached(c, v, k == "upper") for k, v in e.items()}
    second = {f"_t_{c}_least": f"greatest(_t_{c}_lower, _t_{c}_upper)", f"_t_{c}_most": f"least(_t_{c}_lower, _t_{c}_upper)"}
    deficient = f"locations_kind = 'insufficient_information' AND NOT {A_MET} AND b <> 'met'"
    second[f"_case_{c}"] = f"CASE WHEN {best} IS NULL THEN 0 WHEN least(_t_{c}_lower, _t_{c}_upper) = {lc} THEN 1 WHEN {deficient} THEN 2 ELSE 3 END"
    listed = {"best": f"_l_{c}_best", "least": f"greatest(_l_{c}_lower, _l_{c}_upper)", "most": f"least(_l_{c}_lower, _l_{c}_upper)"}
    third = {f"_r_{c}_{k}": f"CASE _case_{c} WHEN 0 THEN {ne} WHEN 1 THEN _t_{c}_{k} WHEN 2 THEN {dd} ELSE {x} END" for k, x in listed.items()}
    return [first, second, third]


def _spatial_notes(c: str) -> dict[str, str]:
    """When each note of B1 or B2 is made, in order."""
    return {
        "metric_missing": f"_case_{c} = 0",
        "metric_above_all_thresholds": f"_case_{c} = 1",
        "locations_insufficient_information": f"_case_{c} = 2",
        "subconditions_not_assessed": f"_case_{c} = 3 AND _pending > 0",
        "subconditions_refuted": f"_case_{c} = 3 AND _pending = 0 AND _r_{c}_most = {RANK['LC']}",
        "near_threatened_may_apply": f"_case_{c} = 3 AND locations_kind = 'count' AND locations <= {NT_TRIGGER[c]}",
    }


def _b3() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Case, range and notes of B3: both limbs, never above VU."""
    bound, lc, vu = max_locations("B3", "VU"), RANK["LC"], RANK["VU"]
    many = f"locations_kind = 'count' AND locations > {bound}"
    few = f"locations_kind = 'count' AND locations <= {bound}"
    case = f"""CASE WHEN locations_kind = 'not_assessed' AND b3_rapid_collapse = 'not_assessed' THEN 0 WHEN locations_kind = 'insufficient_information' THEN 1
        WHEN ({many}) OR locations_kind = 'no_plausible_threats' OR b3_rapid_collapse = 'not_met' THEN 2 WHEN {few} AND b3_rapid_collapse = 'met' THEN 3 ELSE 4 END"""
    ranks = {"best": vu, "least": lc, "most": vu}
    columns = {f"_r_B3_{k}": f"CASE _case_B3 WHEN 0 THEN {RANK['NE']} WHEN 1 THEN {RANK['DD']} WHEN 2 THEN {lc} WHEN 3 THEN {vu} ELSE {x} END" for k, x in ranks.items()}
    notes = {
        "b3_not_assessed": "_case_B3 IN (0, 4)",
        "locations_insufficient_information": "_case_B3 = 1",
        "near_threatened_may_apply": f"_case_B3 > 1 AND locations_kind = 'count' AND locations <= {NT_TRIGGER['B3']}",
    }
    return {"_case_B3": case}, columns, notes


def _sentence(kind: str, criterion: str) -> str:
    """A note's sentence."""
    if kind == "subconditions_not_assessed":
        letters = ", ".join(f"IF({when}, '({k})', NULL)" for k, when in PENDING.items())
        return f"concat('sub-condition', IF(_pending = 1, '', 's'), ' ', concat_ws(', ', {letters}), ' not assessed, so the listing is provisional')"
    if kind == "near_threatened_may_apply":
        return f"concat('with ', CAST(locations AS STRING), ' threat-defined locations (<= {NT_TRIGGER[criterion]}), Near Threatened may apply under Guidelines Box 13 step 6(iv) if information is insufficient and less than 30% of the distribution is unthreatened')"
    return f"'{NOTES[kind]}'"


def _struct(kind: str, criterion: str) -> str:
    """A note as a struct."""
    letters = LETTERS if kind == "subconditions_not_assessed" else "NULL"
    at = ("locations", str(NT_TRIGGER[criterion])) if kind == "near_threatened_may_apply" else ("NULL", "NULL")
    return f"CAST(named_struct('kind', '{kind}', 'pending', {letters}, 'locations', {at[0]}, 'max_locations', {at[1]}) AS {NOTE})"


def completed(df: DataFrame) -> DataFrame:
    """df with all input columns: those missing are null, NaN metrics are null, statuses are trimmed and lower-cased, a
    count without a number is not assessed."""
    have = {c.lower() for c in df.columns}
    cols = {c: f"nanvl(CAST({c} AS DOUBLE), CAST(NULL AS DOUBLE))" if c in have else "CAST(NULL AS DOUBLE)" for c in METRICS}
    cols |= {c: f"coalesce(lower(trim({c})), 'not_assessed')" if c in have else "'not_assessed'" for c in STATUSES}
    some = "CASE WHEN locations IS NOT NULL THEN 'count' ELSE 'not_assessed' END" if "locations" in have else "'not_assessed'"
    cols["locations_kind"] = "coalesce(locations_kind, 'not_assessed')" if "locations_kind" in have else some
    cols["locations"] = "CAST(locations AS INT)" if "locations" in have else "CAST(NULL AS INT)"
    checked = {c: f"CASE WHEN {c} IN ('met', 'not_met', 'not_assessed') THEN {c} ELSE CAST(raise_error(concat('{c}: not a status: ', {c})) AS STRING) END" for c in STATUSES if c in have}
    checked["locations_kind"] = "CASE WHEN locations_kind = 'count' AND locations IS NULL THEN 'not_assessed' ELSE locations_kind END"
    return _with(_with(df, cols), checked)


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.expr(x) for k, x in columns.items()})


def _settled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """_with() by a generator of one row, which the optimizer doesn't look through: a filter on a result would otherwise
    have the whole chain of definitions written out in place, thousands of times."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[F.expr(x).alias(k) for k, x in columns.items()]))))


def assess_criterion_b(df: DataFrame) -> DataFrame:
    """df and b1, b2, b3, overall (displayed ranges), b1_threshold, b2_threshold, overall_code, is_threatened, results
    (ranges and notes per sub-criterion), notes (sentences), guidelines_version, thresholds_sha256, engine.

    Ranks are small integers in columns of their own, step by step, so that each is computed once in generated code.
    """
    metrics = {"B1": ("eoo_km2", "eoo_lower", "eoo_upper"), "B2": ("aoo_cells", "aoo_lower", "aoo_upper")}
    each, df = ("B1", "B2", "B3"), completed(df)
    facts = {"_open": OPEN, "_pending": " + ".join(f"CAST({when} AS INT)" for when in PENDING.values())}
    for c, (best, one, other) in metrics.items():
        both = f"{one} IS NOT NULL AND {other} IS NOT NULL"
        facts |= {f"_lower_{c}": f"IF({both}, least({one}, {other}), {best})", f"_upper_{c}": f"IF({both}, greatest({one}, {other}), {best})"}
        facts |= {f"_met_{c}_{level}": _met(c, level) for level in LEVELS}
    df = _with(df, facts)
    b3_case, b3_range, b3_notes = _b3()
    steps = [_spatial(c, best) for c, (best, _, _) in metrics.items()]
    for k, more in enumerate(({}, b3_case, b3_range)):
        df = _settled(df, steps[0][k] | steps[1][k] | more)
    df = _settled(df, {f"_o_{k}": most_threatened_sql([f"_r_{c}" for c in each], k) for k in ("best", "least", "most")})
    notes = {"B1": _spatial_notes("B1"), "B2": _spatial_notes("B2"), "B3": b3_notes}
    said = ", ".join(f"IF({when}, {_sentence(kind, c)}, NULL)" for c, own in notes.items() for kind, when in own.items())
    made = {c: ", ".join(f"IF({when}, {_struct(kind, c)}, NULL)" for kind, when in own.items()) for c, own in notes.items()}
    ranges = {c: ", ".join(f"'{k}', _r_{c}_{k}" for k in ("best", "least", "most")) for c in each}
    results = ", ".join(f"named_struct('criterion', '{c}', 'range', named_struct({ranges[c]}), 'notes', CAST(array_compact(array({made[c]})) AS array<{NOTE}>))" for c in each)
    out = {c.lower(): display_sql(f"_r_{c}") for c in each}
    out |= {f"{c.lower()}_threshold": f"IF({best} IS NOT NULL, {display_sql(f'_t_{c}')}, NULL)" for c, (best, _, _) in metrics.items()}
    out |= {"results": f"array({results})", "overall": display_sql("_o"), "overall_code": code_sql("_o_best"), "is_threatened": f"_o_best <= {RANK['VU']}"}
    out |= {"_said": f"concat_ws('\\n', {said})", "guidelines_version": f"'{thresholds()['guidelines_version']}'", "thresholds_sha256": f"'{SHA256}'", "engine": f"'ecorisk {__version__}'"}
    df = _with(_with(df, out), {"notes": "IF(_said = '', CAST(array() AS array<string>), split(_said, '\\n'))"})
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def documents(assessed: DataFrame) -> DataFrame:
    """Assessed rows and `document`: overall category, ranges, metrics, notes (each said once, in order) and provenance as
    JSON."""
    fields = ["overall", "overall_code", "is_threatened", "b1", "b2", "b3", "b1_threshold", "b2_threshold", "eoo_km2", "aoo_cells"]
    doc = F.struct(*fields, F.array_distinct("notes").alias("notes"), "guidelines_version", "thresholds_sha256", "engine")
    return assessed.withColumn("document", F.to_json(doc))


def report(assessed: DataFrame, name: str, limit: int = 15) -> DataFrame:
    """Text lines of the most threatened rows, worst first: name, overall, b1, b2, b3 in columns of fixed width."""
    rank = F.expr(f"locate(overall_code, '{''.join(c[0] for c in CATEGORIES)}')")
    line = F.concat(F.rpad(F.col(name).cast("string"), 32, " "), *[F.rpad(F.col(c), 14, " ") for c in ("overall", "b1", "b2", "b3")])
    return assessed.orderBy(rank, name).limit(limit).select(F.rtrim(line).alias("line"))


def result_of(df: DataFrame, criterion: str) -> DataFrame:
    """The assessed rows' result for one sub-criterion."""
    return df.withColumn("result", F.filter("results", lambda r: r["criterion"] == criterion)[0])


def parse_status(text: str) -> str:
    out = text.strip().lower()
    if out not in ("met", "not_met", "not_assessed"):
        raise ValueError(f"{text!r} is not a status: met, not_met or not_assessed")
    return out


def parse_clauses(clauses) -> dict[str, str]:
    """Status columns from (clause, status) pairs or CLAUSE=STATUS texts; later ones override."""
    out: dict[str, str] = {}
    for item in clauses:
        clause, status = item.split("=", 1) if isinstance(item, str) else item
        name, value = clause.strip().lower(), parse_status(status)
        if name in ("a", "continuing_decline"):
            out |= dict.fromkeys(("a_i", "a_ii", "a_iii"), value)
        elif name.removeprefix("a.") in ASPECTS:
            out[ASPECTS[name.removeprefix("a.")]] = value
        elif name in ("b", "threatening_processes"):
            out["b"] = value
        elif name in ("b3_rapid_collapse", "capable_of_rapid_collapse"):
            out["b3_rapid_collapse"] = value
        elif name in ("c", "few_locations"):
            raise ValueError("clause (c) follows from the number of locations; give `locations`")
        else:
            raise ValueError(f"no clause {clause!r}")
    return out


def _given(eoo_km2=None, aoo_cells=None, eoo_bounds=None, aoo_bounds=None, clauses=(), locations=None, no_plausible_threats: bool = False, locations_insufficient_information: bool = False) -> tuple:
    """A row of CASE from loose input."""
    if sum((locations is not None, no_plausible_threats, locations_insufficient_information)) > 1:
        raise ValueError("give one of locations, no_plausible_threats and locations_insufficient_information")
    for b in (eoo_bounds, aoo_bounds):
        if b is not None and len(b) != 2:
            raise ValueError("bounds are two values")
    kind = "count" if locations is not None else "no_plausible_threats" if no_plausible_threats else "insufficient_information" if locations_insufficient_information else "not_assessed"
    status = dict.fromkeys(STATUSES, "not_assessed") | parse_clauses(clauses)
    values = [eoo_km2, *(eoo_bounds or (None, None)), aoo_cells, *(aoo_bounds or (None, None))]
    return (*[None if v is None else float(v) for v in values], *[status[c] for c in STATUSES], kind, locations)


CASE = ", ".join([f"{c} double" for c in METRICS] + [f"{c} string" for c in STATUSES] + ["locations_kind string", "locations int"])


def assess_cases(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """Assessments from loose input, numbered by `case`: each is a dict of criterion_b's arguments."""
    return assess_criterion_b(spark.createDataFrame([(k, *_given(**c)) for k, c in enumerate(cases)], f"case int, {CASE}"))


def criterion_b(spark: SparkSession, **given) -> dict:
    """One assessment from loose input, as a dict: eoo_km2, aoo_cells, eoo_bounds, aoo_bounds, clauses, locations,
    no_plausible_threats, locations_insufficient_information."""
    return assess_cases(spark, [given]).drop("case").first().asDict(recursive=True)
