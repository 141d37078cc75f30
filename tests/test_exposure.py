import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators.enrich import letter_counts
from panelloom.operators.pick import with_ordinal
from panelloom.plans.dataset import build_report_dataset
from panelloom.plans.exposure import build_exposure, store_exposure
from panelloom.sources import store

SCORED = [("33-1012", "Police supervisor", 0.0), ("43-9061.00", "Office clerk", 0.45), ("15-1252", "Software developer", 0.75),
          ("53-3032", "Truck driver", 0.05), ("25-2021", "School teacher", 0.2)]
NOTES = [("0011", "Oficial de oficina"), ("2511", "Profesor"), ("2512", "Software"), ("8432", "Truck conductor")]


def test_ordinals(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in np.random.default_rng(0).permutation(200)], ["k"]).repartition(7)
    rows = {r.k: r.ordinal for r in with_ordinal(df, "k").collect()}
    assert rows == {f"k{i:03d}": i for i in range(200)}


@pytest.mark.parametrize("methods", [("cosine_weighted", "cosine_nearest"), ("rf", "cosine_weighted", "cosine_nearest")])
def test_build_exposure(spark, tmp_path, methods):
    scored = spark.createDataFrame(SCORED, ["occ_code", "title", "observed_exposure"])
    about = spark.createDataFrame([("15-1252.00", "Writes code")], ["occ_code", "onet_description"])
    taxonomy = spark.createDataFrame([(c, c[:2], c[:1], t, t) for c, t in NOTES],
                                     ["CNO4", "CNO2", "OCUP1", "occupation_title", "embedding_text"])
    records = spark.createDataFrame([("2025Q1", "A", "0", 2.0), ("2025Q1", "A", "2", 1.0), ("2025Q1", "B", "8", 4.0),
                                     ("2025Q1", "B", "9", 4.0)], ["quarter", "ACT1", "OCUP1", "FACTOREL"])
    weights = spark.createDataFrame([("00", 1.0), ("25", 1.0), ("84", 1.0)], ["CNO2", "employment_weight"])
    labels = spark.createDataFrame([("2", "Técnicos")], ["OCUP1", "occupation_title"])
    out = build_exposure(scored, about, taxonomy, records, letter_counts, str(tmp_path / "cache"), "letters", weights, labels,
                         weight="FACTOREL", methods=methods, trees=5)

    texts = ["O*NET occupation: Software developer. Description: Writes code" if t == "Software developer" else t
             for _, t, _ in SCORED]
    order = np.argsort([c.removesuffix(".00") for c, _, _ in SCORED])
    s = np.array(letter_counts([texts[i] for i in order]))
    t = np.array(letter_counts([x for _, x in NOTES]))
    y = np.array([SCORED[i][2] for i in order])
    sims = (t @ s.T) / np.outer(np.linalg.norm(t, axis=1), np.linalg.norm(s, axis=1))
    near = y[sims.argmax(axis=1)]
    near[0] = 0.0  # the audited code
    leaves = {r.CNO4: r for r in out.leaves.collect()}
    assert [leaves[c].observed_exposure_cosine_nearest for c, _ in NOTES] == pytest.approx(list(near))
    assert ("observed_exposure_rf" in out.leaves.columns) == ("rf" in methods)
    occupations = {r.OCUP1: r for r in out.occupations.collect()}
    assert occupations["2"].occupation_title == "Técnicos" and occupations["8"].occupation_title == "OCUP1 8"
    assert occupations["2"].observed_exposure_cosine_nearest == pytest.approx((near[1] + near[2]) / 2)
    industries = {r.cnae: r for r in out.industries.collect()}
    assert industries["B"].coverage_share == pytest.approx(.5)
    assert industries["A"].observed_exposure_cnae_cosine_nearest == pytest.approx(
        (2 * near[0] + occupations["2"].observed_exposure_cosine_nearest) / 3)
    audited = out.matches.where("CNO4 = '0011'").collect()
    assert {(r.method, r.occ_code) for r in audited} == {(m, "33-1012") for m in ("cosine_weighted", "cosine_nearest")}
    assert out.matches.where(F.col("method") == "cosine_nearest").count() == 4
    metrics = {r.method: r for r in out.metrics.collect()}
    assert set(metrics) == {"global_mean", *(("random_forest",) if "rf" in methods else ()), "cosine_weighted", "cosine_nearest"}
    left_out = [np.mean([v for j, v in enumerate(y) if j != i]) for i in range(5)]  # five rows, five folds
    assert metrics["global_mean"].n == 5 and metrics["global_mean"].mae == pytest.approx(np.mean(np.abs(y - left_out)))
    for run in (1, 2):
        record = store_exposure(out, str(tmp_path / "store"), "letters", "none", "0" * 64).first()
        assert (record.occupations_version, record.industries_version) == (str(run), str(run))
    kept = store.KeyedTable(spark, str(tmp_path / "store" / "occupations"), store.OCCUPATION_SCHEMA, store.OCCUPATION_KEY).read()
    assert kept.count() == len(occupations) and spark.read.csv(record.matches, header=True).count() == out.matches.count()


def test_forest_alone_needs_no_similarities(spark, tmp_path):
    scored = spark.createDataFrame(SCORED, ["occ_code", "title", "observed_exposure"])
    about = spark.createDataFrame([], "occ_code string, onet_description string")
    taxonomy = spark.createDataFrame([(c, c[:2], c[:1], t, t) for c, t in NOTES], ["CNO4", "CNO2", "OCUP1", "occupation_title", "embedding_text"])
    records = spark.createDataFrame([("2025Q1", "A", "0")], ["quarter", "ACT1", "OCUP1"])
    out = build_exposure(scored, about, taxonomy, records, letter_counts, str(tmp_path / "cache"), "letters", methods=("rf",), trees=3)
    assert out.matches.isEmpty() and out.leaves.columns[-1] == "observed_exposure_rf" and out.industries.count() == 1


def test_report_dataset_is_resumable(spark, tmp_path):
    head = "<h2>CNO-{c}: Oficio Enero 2020</h2><table><caption>Distribución geográfica de contratos</caption><tr><td>Lugo</td><td>{n}</td></tr></table>"
    page = lambda c, n: (head.format(c=c, n=n), f"https://x/_mensuales_2020_01_{c}-x.html")
    pages = lambda *rows: spark.createDataFrame(list(rows), ["html", "url"])
    scores = spark.createDataFrame([("12", .5)], ["cno4", "observed_exposure"])
    target = str(tmp_path / "wide")
    build_report_dataset(pages(page("0012", 3)), scores, target)
    rows = build_report_dataset(pages(page("0012", 999), page("7777", 4)), scores, target).where("category = 'Lugo'").collect()
    assert {(r.cno4, r.contratos, r.observed_exposure) for r in rows} == {("0012", 3.0, .5), ("7777", 4.0, None)}


def test_unknown_methods(spark):
    with pytest.raises(ValueError, match="unknown methods"):
        build_exposure(None, None, None, None, letter_counts, "", "m", methods=("svm",))
