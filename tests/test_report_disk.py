import os

from panelloom.plans import dataset
from panelloom.session import SHUFFLE_CLEANUP, shuffles_deleted
from panelloom.sources import store


def pages(spark, *reports):
    body = ("<h2>CNO-{c}: Oficio {m} 2020</h2><table><caption>Distribución geográfica de contratos</caption><tr><td>Lugo</td><td>{n}</td></tr>"
            "<tr><td>Vigo</td><td>1</td></tr></table>")
    return spark.createDataFrame([(body.format(c=c, m=m, n=n), f"https://x/{c}-{i}") for i, (c, m, n) in enumerate(reports)], ["html", "url"])


def test_pages_are_never_moved_and_their_facts_once(spark, tmp_path, monkeypatch):
    joined, written = [], []
    drop, append = dataset.joins.drop_finished, store.AppendTable.append
    monkeypatch.setattr(dataset.joins, "drop_finished", lambda df, *rest: joined.append(df) or drop(df, *rest))
    monkeypatch.setattr(store.AppendTable, "append", lambda self, rows, *rest: written.append(rows) or append(self, rows, *rest))
    scores = spark.createDataFrame([("0012", .5)], ["cno4", "observed_exposure"])
    target = str(tmp_path / "wide")
    dataset.build_report_dataset(pages(spark, ("0012", "Enero", 3)), scores, target)
    out = dataset.build_report_dataset(pages(spark, ("0012", "Enero", 999), ("0012", "Marzo", 5), ("0077", "Enero", 4), ("0077", "Enero", 9)), scores, target)
    assert [("html" in df.columns) for df in joined] == [False]
    for rows in written:
        dealt = [x for x in rows._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
        assert dealt and not [x for x in dealt if "dimension" in x or "measure" in x]
    got = {(r.cno4, r.period, r.category): (r.contratos, r.observed_exposure) for r in out.collect()}
    assert got == {("0012", "2020-01", "Lugo"): (3, .5), ("0012", "2020-01", "Vigo"): (1, .5), ("0012", "2020-01", "Total"): (4, .5),
                   ("0012", "2020-03", "Lugo"): (5, .5), ("0012", "2020-03", "Vigo"): (1, .5), ("0012", "2020-03", "Total"): (6, .5),
                   ("0077", "2020-01", "Lugo"): (4, None), ("0077", "2020-01", "Vigo"): (1, None), ("0077", "2020-01", "Total"): (5, None)}


def test_what_a_layer_shuffled_is_deleted(spark, tmp_path):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].toString()
    files = lambda: {f for d, _, names in os.walk(folder) for f in names if f.startswith("shuffle_")}
    table = store.KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ["k"])
    before = files()
    table._lay_down(spark.range(2000).selectExpr("id k", "cast(id AS string) v").repartition(3, "v"))
    assert not files() - before


def test_writes_at_the_same_time_leave_the_setting_as_it_was(spark):
    first, second = shuffles_deleted(spark), shuffles_deleted(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)  # the first to begin ends first
    assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
    second.__exit__(None, None, None)
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
