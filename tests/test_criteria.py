import pytest
from pyspark.sql import functions as F

from ecorisk.functions import categories
from ecorisk.operators.criteria import criterion_b, parse_clauses

MET = [("a", "met")]


@pytest.mark.parametrize(
    "given, expected",
    [
        ({"eoo_km2": 2000, "clauses": MET}, ("CR", "NE", "NE", "CR")),
        ({"eoo_km2": 2000.01, "clauses": MET}, ("EN", "NE", "NE", "EN")),
        ({"eoo_km2": 20001, "clauses": MET}, ("VU", "NE", "NE", "VU")),
        ({"eoo_km2": 50001, "clauses": MET}, ("LC", "NE", "NE", "LC")),
        ({"aoo_cells": 2, "clauses": MET}, ("NE", "CR", "NE", "CR")),
        ({"aoo_cells": 51, "clauses": MET}, ("NE", "LC", "NE", "LC")),
        ({"eoo_km2": 1500, "clauses": [("a", "not_met"), ("b", "not_met")], "locations": 3}, ("EN", "NE", "VU (LC-VU)", "EN")),
        ({"eoo_km2": 1500, "locations_insufficient_information": True}, ("DD", "NE", "DD", "DD")),
        ({"eoo_km2": 60000, "locations_insufficient_information": True}, ("LC", "NE", "DD", "LC")),
        ({"eoo_km2": 1500, "eoo_bounds": (1000, 3000), "clauses": MET}, ("CR (EN-CR)", "NE", "NE", "CR (EN-CR)")),
        ({"locations": 4, "clauses": [("b3_rapid_collapse", "met")]}, ("NE", "NE", "VU", "VU")),
        ({"no_plausible_threats": True}, ("NE", "NE", "LC", "LC")),
        ({}, ("NE", "NE", "NE", "NE")),
    ],
)
def test_cases(spark, given, expected):
    out = criterion_b(spark, **given)
    got = out["b1"], out["b2"], out["b3"], out["overall"]
    assert got == expected


def test_notes(spark):
    out = criterion_b(spark, eoo_km2=1500, clauses=MET)
    assert "sub-conditions (b), (c) not assessed, so the listing is provisional" in out["notes"]
    assert "no metric was supplied, so this criterion could not be evaluated" in out["notes"]
    out = criterion_b(spark, eoo_km2=1500, clauses=[("a", "not_met"), ("b", "not_met")], locations=11)
    assert out["b1"] == "LC" and any(n.startswith("every sub-condition was assessed") for n in out["notes"])
    assert any(n.startswith("with 3 threat-defined locations (<= 9)") for n in criterion_b(spark, eoo_km2=1500, locations=3)["notes"])


def test_loose_input():
    assert parse_clauses(["a=met", "a.ii=not_met", " B = MET "]) == {"a_i": "met", "a_ii": "not_met", "a_iii": "met", "b": "met"}
    for bad in (["c=met"], ["a=unknown"], ["z=met"]):
        with pytest.raises(ValueError):
            parse_clauses(bad)


def test_tables(spark):
    assert categories.category_table(spark).where("is_threatened").count() == 4
    assert categories.criterion_table(spark).count() == 16
    assert categories.parse_category(" cr ") == "CR" and categories.parse_criterion("a2B") == "A2b"
    with pytest.raises(ValueError):
        categories.thresholds("1.0")
    with pytest.raises(ValueError):
        categories.rule("A1")
    row = spark.range(1).select(categories.classify("B1", F.lit(float("nan"))).alias("x")).first()
    assert row["x"] == categories.RANK["NE"]


def test_filters_on_results_stay_small(spark):
    from ecorisk.operators.criteria import assess_criterion_b, documents, report

    df = spark.createDataFrame([(k, 400.0 * k, "met" if k % 2 else "not_assessed", k % 7) for k in range(300)], "id int, eoo_km2 double, a_i string, locations int")
    out = assess_criterion_b(df).where("overall = 'CR' AND is_threatened")
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    assert {r.id for r in out.collect()} == {k for k in range(300) if 400 * k <= 2000 and (k % 2 or k % 7 <= 1)}
    doc = documents(assess_criterion_b(df)).where("id = 6").first()
    assert '"overall":"EN' in doc.document and doc.document.count("Near Threatened") == 1  # B2 has no metric
    lines = [r.line for r in report(assess_criterion_b(df), "id", 3).collect()]
    assert len(lines) == 3 and all(x.split()[1] == "CR" for x in lines)


def test_odd_rows(spark):
    from ecorisk.operators.criteria import assess_criterion_b

    df = spark.createDataFrame([(None, " MET ", "count", None), (float("nan"), None, None, 3)], "eoo_km2 double, a_i string, locations_kind string, locations int")
    assert [(r.b1, r.b3) for r in assess_criterion_b(df).collect()] == [("NE", "NE"), ("NE", "NE")]
    with pytest.raises(Exception, match="not a status"):
        assess_criterion_b(spark.createDataFrame([("perhaps",)], "b string")).collect()
    with pytest.raises(ValueError, match="one of"):
        criterion_b(spark, locations=3, no_plausible_threats=True)
