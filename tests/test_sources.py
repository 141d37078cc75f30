import uuid

import pytest
from pyspark.sql import functions as F

from panelloom.operators.reshape import long_to_wide
from panelloom.sources import files, lookup, reports, store, taxonomy
from panelloom.streaming import resumable

MONTHS = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre"]


def shown(n):
    """A number as the pages write it: dots between thousands, a dash for zero."""
    return f"{n:,}".replace(",", ".") if n else "-"


def table(caption, rows):
    cells = "".join("<tr>" + "".join(f"<td class='n'> {c} </td>" for c in row) + "</tr>" for row in rows)
    return f"<table id='t'>{f'<caption>{caption}</caption>' if caption else ''}{cells}</table>"


def report(code, title, year, month, banners=(), tables=(), mobility=None):
    """A page from its parts: banners are (title, [(number, unit)]), tables (caption, rows), mobility (genders, {category: numbers})."""
    out = [f"<html><h2> CNO-{code}: {title} {MONTHS[month - 1]} {year} </h2>"] + [table(*t) for t in tables]
    for name, figures in banners:
        out.append(f'<div class="x se-databanner"><h4 class="se-databanner--title">{name}</h4>' + "".join(
            f'<p class="se-databanner--figure"><b class="se-databanner--digit">{shown(n)}</b> {unit}</p>' for n, unit in figures) + "</div>")
    if mobility:
        genders, moves = mobility
        out.append("<script>drawStuffMovilidad();" + "".join(f"d.addColumn('number', '{g}');" for g in genders) + "".join(
            f"d.addRow(['{c}', {', '.join(map(str, v))}]);" for c, v in moves.items()) + "</script>")
    return "".join(out) + "</html>"


AGES = {"16-17": 3, "30-44": 1204, "mayores de 54": 77}
SEXES = {"Mujer": 640, "Hombre": 644}
PLACES = {"Huesca": 15, "Lugo": 0, "Teruel": 1302, "Cuenca": 9}
STAYING, MOVING = 318, 45


def full_report():
    stock = [("Por tramos de edad", ""), *[(k, shown(v)) for k, v in AGES.items()], ("Zamora",), ("Por sexo", ""), *[(k, shown(v), "x") for k, v in SEXES.items()]]
    places = [("Provincia", "Contratos"), *[(k, shown(v)) for k, v in PLACES.items()], ("Sin dato",)]
    moves = [("N&ordm; de contratos que se mueven (2)", shown(MOVING)), ("Otra fila", "12"), ("N&ordm; de contratos que permanecen", shown(STAYING))]
    return report("7131", "Cristaleros &amp; vidrieros", 2021, 6, banners=[("Contratos y personas", [(2871, "personas"), (3350, "contratos")])],
                  tables=[("Movilidad geogr&aacute;fica de la contrataci&oacute;n", moves), (None, [("a", "1")]), ("Un t&iacute;tulo desconocido", [("Lugo", "4")]),
                          ("Distribuci&oacute;n geogr&aacute;fica de contratos", places), ("Parados seg&uacute;n sexo y edad", stock)],
                  mobility=(["Mujer", "Hombre"], {"Se mueven": [20, 25], "Permanecen": [151, 167]}))


def expected_of_full_report():
    out = {("contratos", "total", "Total", "Total"): 3350, ("personas", "total", "Total", "Total"): 2871}
    out |= {("parados", "age", k, "Total"): v for k, v in AGES.items()} | {("parados", "gender", k, k): v for k, v in SEXES.items()}
    out |= {("contratos", "province", k, "Total"): v for k, v in PLACES.items() if v}  # a dash is no number
    out[("contratos", "province", "Total", "Total")] = sum(PLACES.values())
    moved = {"Permanecen": STAYING, "Se mueven": MOVING}
    out |= {("contratos", "geographic_mobility", k, "Total"): v for k, v in moved.items()}
    out[("contratos", "geographic_mobility", "Total", "Total")] = sum(moved.values())
    for category, numbers in {"Se mueven": [20, 25], "Permanecen": [151, 167]}.items():
        out |= {("contratos", "geographic_mobility", category, g): v for g, v in zip(["Mujer", "Hombre"], numbers)}
    return out


def scratch(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def facts(spark, html, url="https://x/none.html"):
    rows = reports.report_facts(spark.createDataFrame([(html, url)], ["html", "url"]))
    return rows, {(r.measure, r.dimension, r.category, r.gender): r.value for r in rows.collect()}


def test_report_facts(spark):
    rows, got = facts(spark, full_report())
    assert got == expected_of_full_report()
    first = rows.first()
    assert (first.cno4, first.period, first.occupation_title) == ("7131", "2021-06", "Cristaleros & vidrieros")


def test_report_with_cells_and_rows_left_open(spark):
    page = full_report()
    loose = page.replace("</td>", "").replace("</tr>", "").replace("</th>", "").replace("<td", "<TD title='a > b'")
    assert loose != page and facts(spark, loose)[1] == expected_of_full_report()
    cut = page[:page.index("</table>", page.index("Parados seg"))]  # the file ends inside the last table
    stock = {k: v for k, v in facts(spark, cut)[1].items() if k[1] in ("age", "gender")}
    assert stock == {k: v for k, v in expected_of_full_report().items() if k[1] in ("age", "gender")}


def test_markup_that_is_not_shown_counts_for_nothing(spark):
    hidden = full_report().replace("<html>", "<html><!-- <h2>CNO-0000: Nada enero 1999</h2> --><style>h2:after{content:'<h2>CNO-1'}</style>")
    assert facts(spark, hidden)[1] == expected_of_full_report() and facts(spark, hidden)[0].first().cno4 == "7131"


def test_pages_without_html(spark):
    frame = spark.createDataFrame([(None, "https://x/_mensuales_2017_08_9602-x.html"), ("", "https://x/_mensuales_2017_08_9602-x.html")], "html string, url string")
    assert reports.report_facts(frame).collect() == [] and reports.anchors(frame).collect() == []


def test_report_without_some_sections(spark):
    empty = report("0020", "Suboficiales", 2019, 12, tables=[("Distribuci&oacute;n geogr&aacute;fica de parados", [])])
    assert facts(spark, empty)[1] == {("parados", "province", "Total", "Total"): 0}
    assert facts(spark, report("0020", "Suboficiales", 2019, 12))[1] == {}


def test_wide_panel_has_one_total_row(spark):
    total = long_to_wide(facts(spark, full_report())[0]).where("category = 'Total'").collect()
    assert len(total) == 1 and total[0].dimension == "total"
    # the flow's total comes from the first section by name, mobility; no section has a total of the stock
    assert (total[0].parados, total[0].contratos, total[0].personas) == (None, STAYING + MOVING, 2871)


@pytest.mark.parametrize("stock, contracts, people", [(1_000_001, 7, 6), (0, 52_000, 0), (810, 0, 11)])
def test_banner_only_page(spark, stock, contracts, people):
    page = report("5110", "Cocineros", 2018, 1, banners=[("Contratos", [(contracts, "contratos"), (people, "personas")]), ("Parados", [(stock, "parados")])])
    want = {("parados", "total"): stock, ("contratos", "total"): contracts, ("personas", "total"): people}
    assert {k[:2]: v for k, v in facts(spark, page)[1].items()} == {k: v for k, v in want.items() if v}


def test_identity_from_address_file_name_or_error(spark):
    pages = spark.createDataFrame([("<p/>", "https://x/_mensuales_2017_08_9602-x.html", "0011_2020-01.html"),
                                   ("<p/>", "https://x/_mensuales_2017_08_9602-x.html", "other.html")], ["html", "url", "f"])
    assert [(r.cno4, r.period) for r in reports.with_identity(pages).collect()] == [("9602", "2017-08")] * 2
    assert [(r.cno4, r.period) for r in reports.with_identity(pages, file_name="f").collect()] == [
        ("0011", "2020-01"), ("9602", "2017-08")]
    with pytest.raises(Exception, match="identity"):
        reports.with_identity(spark.createDataFrame([("<p/>", "https://x")], ["html", "url"])).collect()


def test_report_links(spark):
    link = "informacion-mercado-trabajo-por-ocupacion"
    cells = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    html = "<h3>CNO-8331: Maquinistas</h3><table>" + cells("Anual", "2019", f"<a href='b/{link}-anual~_anuales_2019_8331.html'>v</a>") + cells(
        "Febrero", "2020", f"<a class=q href='b/{link}~_mensuales_2020_02_8331.html?a=1&amp;b=2'>v</a>") + cells("Marzo") + cells(
        "", "2020", f"<a href='/{link}~_mensuales_x.html'>v</a>") + "</table>"
    rows = reports.report_links(spark.createDataFrame([("8331", html)], ["cno4", "html"]), "https://h.example/b/c.html").collect()
    assert [tuple(r) for r in rows] == [("8331", "Maquinistas", "2020-02", f"https://h.example/b/b/{link}~_mensuales_2020_02_8331.html?a=1&b=2")]


LINES = ["Sin código todavía", "5831 Conserjes de", "edificios", "Nota: cuidan una finca.", "Ejemplos de ocupaciones incluidas en este grupo primario", "- Portero",
         "- Guarda de fin- ca", "Entre sus tareas se incluyen:", "- abrir y cerrar;", "58 Otro nivel", "- repartir el correo.", "5840 Cuidadores",
         "Los cuidadores pasean perros.", "Ocupaciones afines no incluidas en este grupo primario", "- Adiestradores, 9999", "5831 De nuevo", "Los otros.",
         "Cambios respecto a la versión anterior del documento", "5892 Nunca"]


@pytest.mark.parametrize("chunk", [2, 1000])
def test_taxonomy_records(spark, chunk):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(LINES)], ["doc", "line_no", "text"])
    rows = {r.CNO4: r for r in taxonomy.taxonomy_records(df, chunk_lines=chunk).collect()}
    assert set(rows) == {"5831", "5840"}
    assert (rows["5831"].CNO2, rows["5831"].OCUP1, rows["5831"].occupation_title) == ("58", "5", "Conserjes de edificios")
    assert rows["5831"].embedding_text == (
        "CNO occupation: 5831 Conserjes de edificios. Definition: Nota: cuidan una finca. Typical tasks: abrir y cerrar; repartir el correo. "
        "Examples included: Portero; Guarda de finca")
    assert rows["5840"].embedding_text == (
        "CNO occupation: 5840 Cuidadores. Definition: Los cuidadores pasean perros. Related or excluded occupations: Adiestradores, 9999")


def test_long_sections_are_cut_at_a_word(spark):
    lines = ["9210 Mozos"] + [f"El trabajo número {i} sigue." for i in range(200)]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], ["doc", "line_no", "text"])
    got = taxonomy.taxonomy_records(df, chunk_lines=16).first().embedding_text
    want = " ".join(lines[1:])[:1200].rsplit(" ", 1)[0].rstrip(" ,;") + "."
    assert got == "CNO occupation: 9210 Mozos. Definition: " + want


def test_bare_bullets_take_no_room(spark):
    lines = ["9210 Mozos", "Los mozos mueven cosas.", "Entre sus tareas se incluyen:"] + ["-"] * 40 + [f"- tarea número {i} del grupo;" for i in range(44)]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(lines)], ["doc", "line_no", "text"])
    got = taxonomy.taxonomy_records(df).first().embedding_text
    want = " ".join(t[2:] for t in lines[43:])
    assert len(want) < 1200 and got == "CNO occupation: 9210 Mozos. Definition: Los mozos mueven cosas. Typical tasks: " + want


@pytest.mark.parametrize("line,stop", [("Anexo I", True), (" - Anexo II. Lista", True),
                                       ("Cambios respecto a la versión anterior del documento", True),
                                       ("Ocupaciones afines no incluidas", False)])
def test_stop_lines(spark, line, stop):
    assert spark.createDataFrame([(line,)], ["t"]).select(taxonomy.is_stop_line(F.col("t")).alias("s")).first().s is stop


CELLS = [["Código", "Descripción", None], ["8", "Before any mark", None], ["TOCUP", "x", "OTRA"], ["Código", "Descripción", None], ["9", "Other list", None],
         [None, None, None], ["TOCUP", None, "OCUP1 (a un dígito)"], ["Código", "Descripción", None], ["7", "Artesanos (códigos CNO-2011) textiles", None],
         ["4", "Administrativos (códigos CNO-2011)", None], ["7", "Repetido", None], [None, None, None], ["5", "After the end", None]]


@pytest.mark.parametrize("chunk", [2, 1000])
def test_marked_lookup(spark, chunk):
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate(CELLS)], "sheet string, row_no int, cells array<string>")
    rows = {r.OCUP1: r.occupation_title for r in lookup.marked_lookup(df, lookup.OCCUPATIONS, chunk_lines=chunk).collect()}
    assert rows == {"7": "Artesanos textiles", "4": "Administrativos"}
    assert lookup.marked_lookup(df, lookup.INDUSTRIES).isEmpty()
    with pytest.raises(ValueError):
        lookup.marked_lookup(df.where("row_no < 6"), lookup.OCCUPATIONS)


def test_scored_table(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("occ_code,title\n11-1011,Chief\n")
    with pytest.raises(ValueError, match="observed_exposure"):
        files.read_scored(spark, str(path))
    good = tmp_path / "good.csv"
    good.write_text('occ_code,title,observed_exposure\n 11 ," Chief, big",0.5\n12,Clerk,x\n13,,0.1\n')
    assert [tuple(r) for r in files.read_scored(spark, str(good)).collect()] == [("11", "Chief, big", .5)]


def test_quotes_span_lines_in_small_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text('occ_code,title,observed_exposure\n51,"Chief\nof all",0.25\n52,Clerk,0.5\n')
    assert sorted(r.title for r in files.read_scored(spark, str(tmp_path / "s.csv")).collect()) == ["Chief\nof all", "Clerk"]


def test_microdata_headers_are_read_file_by_file(spark, tmp_path):
    folder = tmp_path / "both"
    folder.mkdir()
    (folder / "a.csv").write_text("OCUP1,ACT1\n1,A\n2,B\n")
    (folder / "b.csv").write_text("ACT1,OCUP1\nC,3\n")
    manifest = spark.createDataFrame([("2019Q1", str(folder))], ["quarter", "microdata_url"])
    assert sorted((r.OCUP1, r.ACT1) for r in files.read_microdata(spark, manifest).collect()) == [("1", "A"), ("2", "B"), ("3", "C")]


def test_microdata_of_several_layouts(spark, tmp_path):
    (tmp_path / "a.tab").write_text('"ocup1"\t"ACT1"\t"FACTOREL"\t"EXTRA"\n1\t5\t10.5\tx\n \t5\t1\tx\n')
    (tmp_path / "b.csv").write_text("ACT1;OCUP1\n7;2\n")
    (tmp_path / "m.csv").write_text(f"quarter,microdata_url,metadata_url\n2020Q1,{tmp_path}/a.tab,\n2020Q2 ,{tmp_path}/b.csv,\n")
    manifest = files.read_manifest(spark, str(tmp_path / "m.csv"))
    out = files.read_microdata(spark, manifest)
    assert out.columns == ["quarter", "OCUP1", "ACT1", "FACTOREL"]
    assert sorted(tuple(r) for r in out.collect()) == [("2020Q1", "1", "5", "10.5"), ("2020Q2", "2", "7", None)]
    assert files.read_manifest(spark, str(tmp_path / "m.csv"), first=1).first().quarter == "2020Q1"
    (tmp_path / "c.csv").write_text("ACT1;X\n7;2\n")
    bad = spark.createDataFrame([("2020Q3", f"{tmp_path}/c.csv")], ["quarter", "microdata_url"])
    with pytest.raises(ValueError, match="OCUP1"):
        files.read_microdata(spark, bad)


def test_cached_report_files(spark, tmp_path):
    (tmp_path / "7131_2022-04.html").write_text(full_report())
    rows = reports.report_facts(reports.read_report_files(spark, str(tmp_path)), file_name="file_name")
    assert {(r.cno4, r.period) for r in rows.collect()} == {("7131", "2022-04")}


def keyed(spark, tmp_path, **settings):
    return store.KeyedTable(spark, scratch(tmp_path), "k int, v string, w double", ["k"], **settings)


def appended(spark, tmp_path, **settings):
    return store.AppendTable(spark, scratch(tmp_path), "m string, k int, v string", ["m", "k"], "m", **settings)


def rows_of(table):
    return sorted(map(tuple, table.read().collect()))


def test_upsert_replaces_by_key(spark, tmp_path):
    t = keyed(spark, tmp_path)
    assert t.read().isEmpty() and t.version() == 0
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    t.upsert(spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, w double"))
    assert rows_of(t) == [(1, "a", None), (2, None, 5.0), (3, None, 6.0)]
    assert t.version() == 2 and sorted(r.k for r in t.read(1).collect()) == [1, 2]
    wider = store.KeyedTable(spark, t.root, "k int, w double, extra string", ["k"])
    wider.upsert(spark.createDataFrame([(3, "x")], "k int, extra string"))
    assert rows_of(wider) == [(1, None, None), (2, 5.0, None), (3, None, "x")]


def test_upsert_of_one_key_writes_one_bucket(spark, tmp_path):
    t = keyed(spark, tmp_path, buckets=16)
    t.upsert(spark.range(200).selectExpr("cast(id AS int) k", "cast(id AS string) v"))
    before = t.log.latest()[1]["parts"]
    t.upsert(spark.createDataFrame([(77, "new")], "k int, v string"))
    after = t.log.latest()[1]["parts"]
    assert len(before) == 16 and sum(before[p] != after[p] for p in before) == 1
    assert dict((r.k, r.v) for r in t.read().collect()) == {i: "new" if i == 77 else str(i) for i in range(200)}


def test_interleaved_upserts_keep_both_sets_of_keys(spark, tmp_path):
    a = keyed(spark, tmp_path, buckets=2)
    b = store.KeyedTable(spark, a.root, a.schema, a.keys, buckets=99)  # another process that has read the same version
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    b.buckets = 2
    staged_a, staged_b = a.stage(frame([(1, "a"), (2, "a")])), b.stage(frame([(2, "b"), (3, "b")]))
    stale = b.log.latest()
    a.publish(staged_a)
    seen = iter([stale])
    latest, b.log.latest = b.log.latest, lambda: next(seen, None) or latest()  # decides on the state from before a's entry
    b.publish(staged_b)
    assert rows_of(a) == [(1, "a", None), (2, "b", None), (3, "b", None)] and a.version() == 2


def test_upserts_of_several_threads(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    t = keyed(spark, tmp_path, buckets=3, most_layers=2)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: t.upsert(spark.createDataFrame([(i, str(i)), (-1, str(i))], "k int, v string")), range(8)))
    got = {r.k: r.v for r in t.read().collect()}
    assert {k: v for k, v in got.items() if k >= 0} == {i: str(i) for i in range(8)} and got[-1] in map(str, range(8))


def test_compaction_keeps_what_others_add_meanwhile(spark, tmp_path):
    t = keyed(spark, tmp_path, buckets=2, most_layers=99)
    for i in range(4):
        t.upsert(spark.createDataFrame([(1, str(i)), (10 + i, str(i))], "k int, v string"))
    lay_down = t._lay_down

    def late(rows):
        made = lay_down(rows)
        store.KeyedTable(spark, t.root, t.schema, t.keys, most_layers=99).upsert(spark.createDataFrame([(1, "late")], "k int, v string"))
        return made

    t._lay_down = late
    t.compact()
    parts = t.log.latest()[1]["parts"]
    assert max(map(len, parts.values())) == 2 and rows_of(t) == [(1, "late", None)] + [(10 + i, str(i), None) for i in range(4)]
    t._lay_down = lay_down
    t.compact()
    t.vacuum()
    assert max(map(len, t.log.latest()[1]["parts"].values())) == 1 and len(rows_of(t)) == 5


def test_repeated_keys_of_an_upsert_are_an_error(spark, tmp_path):
    t = keyed(spark, tmp_path)
    with pytest.raises(ValueError, match="do not identify"):
        t.upsert(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"))
    assert t.version() == 0


def test_append_adds_what_is_missing(spark, tmp_path):
    t = appended(spark, tmp_path)
    frame = lambda *rows: spark.createDataFrame(rows, "m string, k int, v string")
    t.append(frame(("m1", 1, "a"), ("m1", 1, "0"), (None, 1, "n")))
    t.append(frame(("m1", 1, "new"), ("m1", 2, "b"), ("m 2/x", 1, "c"), (None, 1, "again")))
    version = t.version()
    t.append(frame(("m1", 2, "late")))
    assert t.version() == version  # nothing new, nothing logged
    assert {tuple(r) for r in t.read().collect()} == {("m1", 1, "0"), (None, 1, "n"), ("m1", 2, "b"), ("m 2/x", 1, "c")}


def test_a_batch_of_one_month_reads_one_month(spark, tmp_path):
    t = appended(spark, tmp_path)
    t.append(spark.range(600).selectExpr("concat('m', id % 12) m", "cast(id AS int) k", "'old' v"))
    staged = t.stage(spark.range(640).where("id % 12 = 5").selectExpr("'m5' m", "cast(id AS int) k", "'new' v"))
    left = t.unseen(staged, t.log.latest()[1]["parts"])
    part = staged.popitem()[0]
    assert left.inputFiles() and all(f"layer_part={part}/" in f for f in left.inputFiles())
    assert sorted(r.k for r in left.collect()) == [k for k in range(600, 640) if k % 12 == 5]


def test_two_appends_at_once_add_each_key_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    t = appended(spark, tmp_path, most_layers=3)
    rows = lambda i: spark.range(40).selectExpr("concat('m', id % 3) m", "cast(id AS int) k", f"'{i}' v")
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: store.AppendTable(spark, t.root, t.schema, t.keys, "m", 3).append(rows(i)), range(3)))
    layers = [x for layers in t.log.latest()[1]["parts"].values() for x in layers]
    assert t._files(layers).count() == 40 and len({r.k for r in t.read().collect()}) == 40


def test_a_replayed_batch_is_not_added_again(spark, tmp_path):
    t = appended(spark, tmp_path)
    rows = spark.createDataFrame([("m1", 1, "a")], t.schema)
    t.append(rows, "stream", 0)
    t.append(rows.withColumn("k", F.lit(9)), "stream", 0)
    t.append(rows.withColumn("k", F.lit(2)), "stream", 1)
    assert [r.k for r in t.read().orderBy("k").collect()] == [1, 2]


def test_stream_is_resumable(spark, tmp_path):
    root = scratch(tmp_path)
    df = spark.range(20).selectExpr("id AS k", "id * 2 AS v")
    target = store.AppendTable(spark, root + "/out", df.schema, ["k"], "k")
    for part in (df.where("k < 10"), df):
        part.write.mode("append").parquet(root + "/in")
        resumable.drain(spark, root + "/in", df.schema, target, root + "/ck")
    assert target.read().count() == 20 and target.log.latest()[1]["sources"] == {root + "/ck": 1}
