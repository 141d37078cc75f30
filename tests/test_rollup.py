import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import joins, panel, pick, reshape, rollup
from panelloom.sources import files


def records(seed, weighted=True):
    """Random survey records and scores; one unit has no score at all."""
    rnd = random.Random(seed)
    rows = [(f"{2010 + rnd.randrange(2)}Q{rnd.randint(1, 4)}", rnd.choice("KLM"), rnd.choice("5678"), rnd.randint(1, 90) / 2) for _ in range(120)]
    scores = {u: (rnd.random(), rnd.random()) for u in "567"}
    return [r if weighted else r[:3] for r in rows], scores


@pytest.mark.parametrize("weighted", [True, False])
def test_weighted_exposure_equals_plain_sums(spark, weighted):
    rows, known = records(31, weighted)
    micro = spark.createDataFrame(rows, ["quarter", "ACT1", "OCUP1", "FACTOREL"][:len(rows[0])])
    scores = spark.createDataFrame([(u, *v) for u, v in known.items()], ["OCUP1", "observed_exposure_rf", "observed_exposure_cosine_weighted"])
    got = {(r.cnae, r.quarter): r for r in (rollup.weighted_exposure(micro, scores, weight="FACTOREL") if weighted
                                            else rollup.weighted_exposure(micro, scores)).collect()}
    cells = defaultdict(list)
    for row in rows:
        cells[row[1], row[0]].append((row[2], row[3] if weighted else 1))
    for cell, own in cells.items():
        covered = [(known[u], w) for u, w in own if u in known]
        if not covered:
            assert cell not in got
            continue
        weight = sum(w for _, w in covered)
        r = got[cell]
        assert r.observed_exposure_cnae_rf == pytest.approx(sum(v[0] * w for v, w in covered) / weight)
        assert r.observed_exposure_cnae_cosine_weighted == pytest.approx(sum(v[1] * w for v, w in covered) / weight)
        assert r.coverage_share == pytest.approx(weight / sum(w for _, w in own)) and r.occupation_count == len({u for u, _ in own})


def test_null_keys_are_kept_and_scores_required(spark):
    micro = spark.createDataFrame([("2025Q1", None, "1"), ("2025Q1", "A", None), ("2025Q1", "A", "1")],
                                  "quarter string, ACT1 string, OCUP1 string")
    scores = spark.createDataFrame([("1", .4)], ["OCUP1", "observed_exposure_rf"])
    rows = {r.cnae: r for r in rollup.weighted_exposure(micro, scores).collect()}
    assert set(rows) == {None, "A"} and rows["A"].occupation_count == 2
    with pytest.raises(ValueError, match="observed_exposure"):
        rollup.weighted_exposure(micro, scores.select("OCUP1"))


LEAVES = [("7001", "70", "7", .35, .05), ("7002", "70", "7", .65, .55), ("7003", "70", "7", .5, .0), ("7105", "71", "7", .04, .44), ("7106", "71", "7", .08, None)]
WEIGHTED, NEAREST = "observed_exposure_cosine_weighted", "observed_exposure_cosine_nearest"


def leaves(spark):
    return spark.createDataFrame(LEAVES, ["CNO4", "CNO2", "OCUP1", WEIGHTED, NEAREST])


def plain_mean(column, keep=lambda leaf: True):
    values = [leaf[column] for leaf in LEAVES if keep(leaf) and leaf[column] is not None]
    return sum(values) / len(values)


def test_hierarchical_mean(spark):
    shares = {"70": .9, "71": .3}  # they need not add up to one
    weights = spark.createDataFrame(list(shares.items()), ["CNO2", "employment_weight"])
    row = rollup.hierarchical_mean(leaves(spark), weights).first()
    for name, column in ((WEIGHTED, 3), (NEAREST, 4)):
        want = sum(s * plain_mean(column, lambda leaf: leaf[1] == m) for m, s in shares.items()) / sum(shares.values())
        assert row[name] == pytest.approx(want)
    assert (row.cno4_count, row.cno2_count) == (5, 2) and row.aggregation_weight_source == rollup.WEIGHTED_SOURCE


@pytest.mark.parametrize("weights,source", [(None, rollup.EQUAL_SOURCE), ([("99", 1.0)], rollup.EQUAL_SOURCE)])
def test_hierarchical_mean_without_usable_weights(spark, weights, source):
    table = spark.createDataFrame(weights, ["CNO2", "employment_weight"]) if weights else None
    row = rollup.hierarchical_mean(leaves(spark), table).first()
    assert row.observed_exposure_cosine_weighted == pytest.approx(plain_mean(3))
    assert row.aggregation_weight_source == source and row.cno2_count is None


def test_hierarchical_mean_falls_back_per_group(spark):
    more = leaves(spark).union(spark.createDataFrame([("8990", "89", "8", .11, .22)], leaves(spark).schema))
    weights = spark.createDataFrame([("71", 4.0)], ["CNO2", "employment_weight"])
    rows = {r.OCUP1: r for r in rollup.hierarchical_mean(more, weights).collect()}
    assert rows["8"].aggregation_weight_source == rollup.UNMATCHED_SOURCE and rows["8"].cno2_count == 1
    assert rows["7"][WEIGHTED] == pytest.approx(plain_mean(3, lambda leaf: leaf[1] == "71"))


def test_code_weights(spark):
    amounts = {"31 Navegantes": "12,5", "32 Técnicos de obra": "2.087,5", "33 Nadie": "0"}
    raw = spark.createDataFrame([("Todos", "2019T3", k, v) for k, v in amounts.items()] + [
        ("Todos", "2019T3", "Suma", "4"), ("Todos", "2019T2", "31 Navegantes", "700"), ("Parte", "2019T3", "31 Navegantes", "8")], ["who", "Periodo", "occ", "n"])
    rows = {r.CNO2: r.employment_weight for r in rollup.code_weights(raw, "occ", "n", "Periodo", F.col("who") == "Todos").collect()}
    assert rows == {"31": pytest.approx(12.5 / 2100), "32": pytest.approx(2087.5 / 2100), "33": 0}


def test_share_of_a_zero_total_or_an_unknown_parent(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 0.0), (None, 1.0), (None, 3.0), ("b", None)], "parent string, n double")
    got = [(r.parent, r.n, r.employment_weight) for r in rollup.share_within(rows, "parent", "n").collect()]
    assert sorted(got, key=str) == sorted([("a", 0.0, None), ("a", 0.0, None), (None, 1.0, .25), (None, 3.0, .75), ("b", None, None)], key=str)


def test_quarterly_stock_and_overlap(spark):
    months = {f"2016-{m:02d}": 7.0 * m * m for m in (4, 5, 6, 8, 9)}  # July is missing
    rows = spark.createDataFrame([(m, "total", v) for m, v in months.items()] + [("2016-06", "province", 1e6)], ["period", "dimension", "parados"])
    wide = rows.withColumns({"category": F.lit("Total"), "gender": F.lit("Total")}).where(panel.is_total_row())
    got = {r.quarter: (r.sepe_registered_unemployed, r.sepe_months) for r in rollup.quarterly_stock(wide, "period", "parados").collect()}
    assert got["2016Q2"] == (pytest.approx(sum(months[f"2016-0{m}"] for m in (4, 5, 6)) / 3), 3)
    a = spark.createDataFrame([(f"2016Q{q}", q) for q in (1, 2, 3)], ["quarter", "a"])
    b = spark.createDataFrame([(f"2016Q{q}", -q) for q in (3, 4)], ["quarter", "b"])
    assert [tuple(r) for r in joins.overlapping(a, b).collect()] == [("2016Q3", 3, -3)]
    with pytest.raises(ValueError):
        joins.overlapping(a, b.where("quarter = '2016Q4'"))


USAGE = ["date_start", "date_end", "geo_id", "geo_level", "category_name", "hierarchy_level", "metric_id", "value",
         "node_name", "node_external_id"]


def usage(spark, rows):
    return spark.createDataFrame([(m, m, g, "country", c, h, "pct", v, n, k) for m, g, c, h, v, n, k in rows], USAGE)


def shares(month, values, level=1, category="soc_occupation"):
    return [(month, country, category, level, v, f"group {code}", code) for code, pair in values.items() for country, v in zip(("ESP", "USA"), pair)]


def test_country_usage(spark):
    late = {"53": (4.25, 4.0), "27": (9.5, 11.75), "41": (9.5, 2.0), "19": (.5, .75)}
    df = usage(spark, shares("2024-11", {"53": (80.0, 1.0)}) + shares("2024-12", late) + shares("2024-12", {"41-2031": (70.0, 1.0)}, 0)
               + shares("2024-12", {"q": (60.0, 2.0)}, 2, "request"))
    rows = files.country_usage(df).collect()
    order = sorted(late, key=lambda code: (-late[code][0], code))
    assert [r.soc_major_group for r in rows] == order and {r.date_start for r in rows} == {"2024-12"}
    assert [r.spain_minus_us_pct for r in rows] == [late[code][0] - late[code][1] for code in order]
    with pytest.raises(ValueError, match="USA"):
        files.country_usage(df.where("geo_id = 'ESP'"))


def test_country_usage_needs_both_countries_in_the_latest_slice(spark):
    rows = shares("2024-11", {"53": (8.0, 1.0)}) + [r for r in shares("2024-12", {"53": (8.0, 1.0)}) if r[1] == "ESP"]
    with pytest.raises(ValueError, match="USA"):
        files.country_usage(usage(spark, rows))


def test_label_keys(spark):
    facts = spark.createDataFrame([("1",), ("2",), ("1",), (None,)], "OCUP1 string")
    labels = spark.createDataFrame([("1", "Directores (códigos CNO-2011)"), ("2", "Técnicos sanitarios")],
                                   ["OCUP1", "occupation_title"])
    rows = {r.OCUP1: r.occupation_title for r in joins.label_keys(facts, labels).collect()}
    assert rows == {"1": "Directores", "2": "Técnicos sanitarios"}
    with pytest.raises(ValueError, match="missing labels"):
        joins.label_keys(facts, None)
    assert {r.occupation_title for r in joins.label_keys(facts, None, allow_code_labels=True).collect()} == {
        "OCUP1 1", "OCUP1 2"}


def test_pick_operators(spark):
    df = spark.createDataFrame([("a", 2, "x", 1.0), ("a", 1, "y", 1.0), ("b", 5, None, 0.5)], ["k", "o", "v", "s"])
    assert {(r.k, r.o, r.v) for r in pick.keep_first(df, ["k"], ["o"]).collect()} == {("a", 1, "y"), ("b", 5, None)}
    assert {(r.k, r.v) for r in pick.arg_max(df, ["k"], ["v"], "s", "o").collect()} == {("a", "y"), ("b", None)}
    with pytest.raises(ValueError):
        pick.require_unique(df, ["k"])


def test_growth_needs_positive_endpoints(spark):
    df = spark.createDataFrame([("a", "2021-01", 10.), ("a", "2021-03", 20.), ("b", "2021-01", 0.), ("b", "2021-03", 5.),
                                ("c", "2021-01", 3.)], ["u", "p", "y"])
    rows = reshape.endpoint_growth(df, "u", "p", "y", "2021-01", "2021-03", 2).collect()
    assert len(rows) == 1 and rows[0].growth == pytest.approx(34.657359)


def dense_residuals(rows):
    """rows: (unit, period, value) -> residuals of unit and period dummies, in the same order."""
    units, periods = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.array([[float(u == r[0]) for u in units] + [float(t == r[1]) for t in periods] for r in rows])
    y = np.array([r[2] for r in rows])
    return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]


@pytest.mark.parametrize("parts", [1, 5])
def test_demeaning_of_a_panel_with_holes_equals_dummies(spark, parts):
    rnd = np.random.default_rng(3)
    rows = [(f"u{u}", t, float(rnd.normal() + u + t * t)) for u in range(14) for t in range(9) if rnd.random() > .3]
    rows += [("u0", 0, 3.5), ("u0", 0, 1.5), ("alone", 20, 7.0), ("far", 20, 9.0), ("far", 21, 2.0)]  # repeats, and units apart from the others
    frame = spark.createDataFrame([(*r, -r[2]) for r in rows] + [("u1", 1, None, None), ("u2", 3, float("nan"), None)],
                                  "u string, t int, y double, z double").repartition(parts)
    out = [r for r in panel.demean_two_way(frame, "u", "t", ["y", "z"]).collect()]
    want = sorted(zip([(r[0], r[1], r[2]) for r in rows], dense_residuals(rows)))
    got = sorted(((r.u, r.t, r.y), r.y_demeaned) for r in out if r.z is not None)
    assert [k for k, _ in got] == [k for k, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want], abs=1e-9)
    assert all(r.z_demeaned == pytest.approx(-r.y_demeaned, abs=1e-9) for r in out if r.z is not None)
    assert sum(r.y_demeaned is None for r in out) == 2
    found = panel.two_way_effects(frame, "u", "t", ["y"])
    assert found.converged.all() and found.steps <= 12
    few = panel.two_way_effects(frame, "u", "t", ["y"], most_steps=1)
    assert not few.converged.any()
    assert panel.demean_two_way(frame, "u", "t", ["y"], most_steps=1).where("y_demeaned is not null").isEmpty()


def test_demeaning_of_a_balanced_panel(spark):
    df = spark.createDataFrame([(u, t, float(u * t + u)) for u in range(3) for t in range(4)], ["u", "t", "y"])
    rows = panel.demean_two_way(df, "u", "t", ["y"]).collect()
    assert {(r.u, r.t): round(r.y_demeaned, 9) for r in rows} == {(u, t): (u - 1) * (t - 1.5) for u in range(3) for t in range(4)}
    assert panel.demean_two_way(df.limit(0), "u", "t", ["y"]).collect() == []


def test_results_do_not_depend_on_partitioning(spark):
    micro = spark.createDataFrame([(f"2025Q{i % 4 + 1}", "AB"[i % 2], str(i % 7), float(i % 5)) for i in range(500)],
                                  ["quarter", "ACT1", "OCUP1", "FACTOREL"])
    scores = spark.createDataFrame([(str(i), i / 10) for i in range(5)], ["OCUP1", "observed_exposure_rf"])
    results = [sorted(map(str, rollup.weighted_exposure(micro.repartition(n), scores, weight="FACTOREL").collect()))
               for n in (1, 8)]
    assert results[0] == results[1]
