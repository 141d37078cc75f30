"""Line and near-duplicate removal, components, language ID, toxicity, dialogues and the pipeline against plain versions."""

import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from panelloom.llm import bpe, chat, components, langid, lines, neardup, toxicity
from panelloom.llm import queries as llm_queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# lines ---------------------------------------------------------------------------------------------------------------

def line_docs():
    rnd = random.Random(4)
    pool = [f"Shared line number {i} of the corpus" for i in range(8)] + ["short", "", "ÄÖ shared line with letters that stay"]
    docs = []
    for i in range(60):
        rows = [rnd.choice(pool) if rnd.random() < 0.7 else f"own line {i} {rnd.random()}" for _ in range(rnd.randint(0, 9))]
        rows = [rnd.choice([r, r.upper() if r.isascii() else r, f"  {r}\t", r + "\r", "\x0b" + r]) for r in rows]
        docs.append((i, "\n".join(rows)))
    return docs + [(None, pool[0]), (None, None), (77, None), (78, ""), (79, "\n\n"), (59, docs[59][1]), (80, "x" * 100_000 + "\n" + pool[1])]


@pytest.mark.parametrize("batches, often", [(1, 1000), (5, 1000), (6, 3)])
def test_lines_equal_brute_force(spark, monkeypatch, batches, often):
    monkeypatch.setattr(lines, "OFTEN", often)
    docs = line_docs()
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"KEPT": F.lit("mine"), "key": F.lit(1), "h1": F.lit(2)})
    parts = [frame.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(batches)) == b) for b in range(batches)]
    out = lines.drop_repeated_lines(frame, parts, fanout=2)
    assert out.columns == ["doc_id", "text", "KEPT", "key", "h1", "kept_", "n_lines", "n_dropped"]
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r["kept_"]) for r in out.collect())
    assert got == Counter(brute.lines(docs))


def test_runs_are_compacted_by_level(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(i, f"one line that is shared\na line of its own, number {i}")], "doc_id long, text string"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert [(r.n, r["last"]) for r in runs.repeated().select("n", "last").collect()] == [(5, 4)]


def test_lines_without_documents(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert lines.drop_repeated_lines(frame, [frame]).collect() == [] and lines.drop_repeated_lines(frame, []).collect() == []


def test_file_batches_hold_each_row_once(spark, tmp_path):
    frame = spark.createDataFrame(line_docs(), "doc_id long, text string")
    frame.repartition(6).write.parquet(f"{tmp_path}/docs")
    table = spark.read.parquet(f"{tmp_path}/docs")
    parts = lines.file_batches(table)
    assert len(parts) == 4 and Counter(r.doc_id for p in parts for r in p.collect()) == Counter(r.doc_id for r in frame.collect())
    assert len(lines.file_batches(frame)) == 1 and lines.file_batches(table.where("doc_id > 30"))[0].count() == frame.where("doc_id > 30").count()


def test_lines_stay_in_the_jvm(spark):
    frame = spark.createDataFrame(line_docs(), "doc_id long, text string")
    for df in (lines.drop_repeated_lines(frame, [frame]), chat.rotate(dialogues(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


# near-duplicates -----------------------------------------------------------------------------------------------------

def test_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(60)] + [(200, i) for i in range(201, 260)]
    root = list(range(300))
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame([*edges, (None, 5), (5, None), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(frame).collect()}
    assert got == {n: root[n] for e in edges for n in e if e[0] != e[1]}
    assert components.connected_components(frame.limit(0)).collect() == []


def near_docs(words):
    rnd = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, number = [], iter(range(10_000))
    base = [rnd.choice(vocabulary) for _ in range(120)]
    for _ in range(70):  # one large group with members near and not so near to each other
        own = list(base)
        for _ in range(rnd.randint(0, 9)):
            own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        docs.append((next(number), " ".join(own)))
    for _ in range(25):
        own = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(1, 4)):
            docs.append((next(number), rnd.choice([" ", "\n", "\t "]).join(own).upper()))
            if own:
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
    docs += [(next(number), t) for t in (None, "", " \n", "one", "one", "One two", "one two three four", "Ä b", "ä b", None)]
    return docs


@pytest.mark.parametrize("words, percent, small, block", [(3, 85, 12, 512), (5, 80, 12, 512), (3, 85, 3, 16)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, words, percent, small, block):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = near_docs(words)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"node": F.lit(1), "digest": F.lit("mine"), "component": F.lit(2)})
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame, neardup.Settings(words, percent)).collect()}
    assert got == brute.near_duplicates(docs, words, percent)


def test_near_duplicates_of_odd_tables(spark):
    frame = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "d e f"), (2, "a b c"), (3, "x " * 50_000)], "doc_id long, text string")
    got = Counter(tuple(r) for r in neardup.near_duplicates(frame, neardup.Settings(3, 85)).collect())
    assert sum(got.values()) == 6 and got[(1, 1, 1, True)] == 2 and got[(None, 1, None, True)] == 1 and got[(3, 1, 3, True)] == 1
    assert neardup.near_duplicates(frame.limit(0), neardup.Settings()).collect() == []


def test_signature_plan_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    for similarity in (0.8, 0.85):
        chunks, width = neardup.signature_plan(similarity, 1e-5)
        assert (rng.binomial(chunks * width, 1 - similarity, 200_000) >= 2 * chunks).mean() < 1e-4


# learned models ------------------------------------------------------------------------------------------------------

def spoken(rnd, lang, n):
    syllables = {"en": ["the", "ing", "th", "on"], "de": ["sch", "ung", "ein", "ö"], "fr": ["eau", "tion", "é", "le"]}[lang]
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def language_docs():
    rnd = random.Random(8)
    docs = [(i, spoken(rnd, lang, rnd.randint(3, 120)), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    odd = [(500, None, "en"), (501, "", "en"), (502, "123 !? 456", "de"), (503, "z", None), (None, docs[0][1], "en"), (1, docs[1][1], "de"),
           (504, docs[2][1] * 300, "fr"), (505, "qx zqj xqz jqx " * 60, "en"), (506, "Ω", "de")]
    return docs, odd


def test_language_id(spark):
    docs, odd = language_docs()
    frame = spark.createDataFrame(docs + odd[:3] + odd[4:7], "doc_id long, text string, lang string")
    model = langid.fit(frame.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 3 != 1), F.col("doc_id"))
    assert sorted(set(model.languages)) == ["de", "en", "fr"] and len(model.languages) > 3
    every = spark.createDataFrame(docs + odd, "doc_id long, text string, lang string").withColumn("SCORE", F.lit("mine"))
    out = langid.predict(every, model)
    assert out.columns == ["doc_id", "text", "lang", "SCORE", "lang_pred", "score_", "rejected"]
    got = {r.doc_id: (r.lang_pred, r["score_"], r.rejected) for r in out.collect()}
    assert sum(got[i][0] == lang and not got[i][2] for i, _, lang in docs) >= 119
    assert got[504][0] == "fr" and not got[504][2] and got[None][0] == "en"
    assert all(got[i] == ("und", 0.0, True) for i in (500, 501, 502)) and got[503][0] != "und" and got[506][0] != "und"
    assert got[505][2]  # far from everything
    assert all(0 <= s <= 1 for _, s, _ in got.values())
    same = {r.doc_id: r.lang_pred for r in langid.predict(every.withColumn("lang", F.lit(None).cast("string")), model).collect()}
    assert same == {i: v[0] for i, v in got.items()}  # the language column is no input


def test_language_id_drops_no_language(spark):
    frame = spark.createDataFrame([(i, f"some text of language {i}", f"l{i // 2}") for i in range(6)], "doc_id long, text string, lang string")
    assert set(langid.fit(frame, F.col("doc_id"), languages=3).languages) == {"l0", "l1", "l2"}
    with pytest.raises(ValueError):
        langid.fit(frame, F.col("doc_id"), languages=2)


def test_language_id_without_training_rows(spark):
    frame = spark.createDataFrame([(1, "text", None), (2, None, "en"), (3, "12", "en")], "doc_id long, text string, lang string")
    for rows in (frame, frame.limit(0)):
        assert langid.fit(rows, F.col("doc_id")) is None
    assert {r.lang_pred for r in langid.predict(frame, None).collect()} == {"und"}
    assert langid.predict(frame.limit(0), None).collect() == []


def toxic_examples():
    rnd = random.Random(9)
    rows = []
    for i in range(400):
        toxic = int(i % 4 == 0)
        own = [f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(5, 60))]
        for _ in range(rnd.randint(2, 5) if toxic else 0):
            own.insert(rnd.randrange(len(own)), rnd.choice(["foul", "vilely", "vileness", "rotten"]))
        rows.append((i, " ".join(own), toxic))
    return rows


def test_toxicity(spark):
    rows = toxic_examples()
    kind = "name long, text string, label int"
    model = toxicity.fit(spark.createDataFrame(rows[:300] + [(900, "x", None), (901, None, 0), (902, "y", 5)], kind), bound=320, least_chi2=12.0)
    odd = [(1000, None, 0), (1001, "", 0), (1002, "foul " * 50_000, 1), (1003, "Vile-ish", 0), (None, rows[0][1], 1), (5, rows[4][1], 1)]
    every = spark.createDataFrame(rows + odd, kind).withColumn("Score", F.lit("mine"))
    out = toxicity.score(every, model)
    assert out.columns == ["name", "text", "label", "Score", "score_", "predicted", "evidence"]
    got = [r for r in out.collect()]
    held = [r for r in got if r.name is not None and 300 <= r.name < 400]
    assert sum(r.predicted == r.label for r in held) >= 97
    by = {r.name: r for r in got}
    assert by[1000]["score_"] == by[1001]["score_"] < 0.5 and by[1002].predicted == 1 and all(0 <= r["score_"] <= 1 for r in got)
    near = by[400 - 4].evidence
    assert near and all(e.label == 1 for e in near[:3]) and [e.cosine for e in near] == sorted((e.cosine for e in near), reverse=True)
    with pytest.raises(ValueError):
        toxicity.fit(spark.createDataFrame(rows, kind), bound=10)


def test_block_max_search_equals_brute_force():
    rng = np.random.default_rng(7)
    vectors = []
    for _ in range(500):
        at = np.unique(rng.integers(0, 40, rng.integers(1, 8)))
        weight = rng.integers(1, 4, len(at)).astype(float)
        vectors.append((at, weight / np.sqrt((weight**2).sum())))
    index = toxicity.BlockMaxIndex(vectors, 40)
    dense = np.zeros((500, 40))
    for i, (at, weight) in enumerate(vectors):
        dense[i, at] = weight
    for q in range(100):
        want = sorted((-round(float(s), 12), i) for i, s in enumerate(dense @ dense[q]) if s > 1e-15 and i != q)[:10]
        got = index.nearest(*vectors[q], 10, without=q)
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [-s for s, _ in want])


def test_toxicity_of_few_examples_with_default_settings(spark):
    rnd = random.Random(5)
    marked = [f"slur{i}" for i in range(8)]  # each in at most four examples
    rows = [(i, " ".join([f"w{rnd.randint(0, 40)}" for _ in range(12)] + [marked[(i + j) % 8] for j in range(3) if i % 4 == 0]), int(i % 4 == 0)) for i in range(40)]
    model = toxicity.fit(spark.createDataFrame(rows, "name long, text string, label int"))
    docs = spark.createDataFrame([(i, f"w1 w2 w3 {w} {marked[i - 1]} w5") for i, w in enumerate(marked)] + [(100, "w1 w2 w3 w4 w5"), (101, "w7 w8 w9 w10")], "name long, text string")
    got = {r.name: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == 1 for i in range(8)) and got[100].predicted == got[101].predicted == 0
    assert all(len(r.evidence) > 0 for r in got.values())  # every text with a term has neighbours


def test_labelled_sample_holds_the_rare_label_whole(spark):
    rows = [(i, int(i % 20 == 0)) for i in range(100)] + [(3, 0), (7, None), (8, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, toxic int")
    chosen, sizes = llm_queries.labelled(frame, bound=12)
    got = [tuple(r) for r in chosen.collect()]
    assert sizes == {0: 95, 1: 5} and len(set(got)) == len(got) == 12
    assert {d for d, toxic in got if toxic} == {0, 20, 40, 60, 80}
    chosen, _ = llm_queries.labelled(frame, bound=6)  # neither label gets less than it can
    assert sorted(r.toxic for r in chosen.collect()) == [0, 0, 0, 1, 1, 1]
    assert sorted(tuple(r) for r in llm_queries.labelled(frame, bound=500)[0].collect()) == sorted({r for r in rows if r[1] in (0, 1)})


def test_block_max_search_with_rare_and_common_terms():
    rng = np.random.default_rng(8)
    vectors = []
    for i in range(900):
        at = np.unique(np.concatenate([i % 3 * 30 + rng.integers(0, 30, 8), rng.integers(90, 3000, 12)]))
        weight = rng.random(len(at)) + 0.01
        vectors.append((at, weight / np.sqrt((weight**2).sum())) if i % 10 else vectors[i - 1] if i else (at, weight / np.sqrt((weight**2).sum())))
    index = toxicity.BlockMaxIndex(vectors, 3001)
    assert 0 < index.n_columns < 3000 and index.n_docs > 3 * toxicity.BLOCK
    dense = np.zeros((900, 3001))
    for i, (at, weight) in enumerate(vectors):
        dense[i, at] = weight
    odd = [(np.array([3000]), np.array([1.0])), (np.array([0]), np.array([1.0]))]
    asked, without = vectors[:200] + odd, list(range(200)) + [-1, -1]
    for (at, weight), own, got in zip(asked, without, index.search(asked, 10, without)):
        want = sorted((-round(float(s), 12), i) for i, s in enumerate(dense[:, at] @ weight) if s > 1e-15 and i != own)[:10]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [-s for s, _ in want])


def test_kth_cosine_is_bounded_by_groups(monkeypatch):
    rng = np.random.default_rng(11)
    vectors = []
    for _ in range(3000):
        at, weight = np.unique(rng.integers(0, 400, 9)), rng.random(9) + 0.01
        vectors.append((at, weight[:len(at)] / np.sqrt((weight[:len(at)]**2).sum())))
    index, sizes, partition = toxicity.BlockMaxIndex(vectors, 400), [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *more, **named: sizes.append(a.shape[-1]) or partition(a, *more, **named))
    got = index.search(vectors[:20], 5, list(range(20)))
    assert sizes and max(sizes) <= 3000 / 8  # no search through all examples for the k-th
    dense = np.zeros((3000, 400))
    for i, (at, weight) in enumerate(vectors):
        dense[i, at] = weight
    for q in range(20):
        want = sorted((-round(float(x), 12), i) for i, x in enumerate(dense @ dense[q]) if x > 1e-15 and i != q)[:5]
        assert [i for _, i in got[q]] == [i for _, i in want]


def test_toxicity_without_examples(spark):
    frame = spark.createDataFrame([(1, "a", None)], "name long, text string, label int")
    assert toxicity.fit(frame) is None
    assert [(r.score, r.predicted) for r in toxicity.score(frame, None).collect()] == [(0.0, 0)]
    one = toxicity.fit(spark.createDataFrame([(1, "a", 1)], frame.schema))
    assert toxicity.score(frame, one).collect()[0].score == 1.0


# dialogues -----------------------------------------------------------------------------------------------------------

def dialogues(spark, many=0):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi Ä"), (1, 2, "bob", None), (1, 3, "ann", "\U0001f600 ok"), (1, 3, "bob", "tie"), (2, None, None, "who"),
            (2, 1, "bob", ""), (3, 0, "system", "nobody"), (None, 0, "ann", "lost"), (1, 3, "bob", "tie")]
    rows += [(9, i // 3, f"s{i % 3}", f"message {i}") for i in range(many)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit(7), "speaker": F.lit("mine")})


def test_rotation(spark):
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate(dialogues(spark)).collect()}
    assert sorted(got) == [(1, "ann", 0), (1, "bob", 0), (2, "bob", 0)]
    ann = got[1, "ann", 0]
    assert ann.rendered == ("<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi Ä<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
                            "<|im_start|>assistant\n\U0001f600 ok<|im_end|>\n<|im_start|>user name=bob\ntie<|im_end|>\n<|im_start|>user name=bob\ntie<|im_end|>\n")
    spans = [ann.rendered[int(a):int(b)] for a, b in (s.split("-") for s in ann["mask"].split(","))]
    assert spans == ["Hi Ä<|im_end|>", "\U0001f600 ok<|im_end|>"] and ann.n_learned == sum(map(len, spans)) and ann.n_messages == 6
    assert got[2, "bob", 0].rendered == "<|im_start|>user name=unknown\nwho<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert chat.rotate(dialogues(spark).limit(0)).collect() == []


def test_rotation_in_parts(spark):
    whole = {(r.conv_id, r.speaker): r.rendered for r in chat.rotate(dialogues(spark, 300)).collect()}
    parts = sorted(chat.rotate(dialogues(spark, 300), part_messages=7).collect(), key=lambda r: (r.conv_id, r.speaker, r.part))
    for key, text in whole.items():
        assert "".join(r.rendered for r in parts if (r.conv_id, r.speaker) == key) == text
    for r in parts:
        spans = [r.rendered[int(a):int(b)] for a, b in (s.split("-") for s in r["mask"].split(",") if s)]
        assert all(s.endswith("<|im_end|>") for s in spans) and len(spans) == r.rendered.count("<|im_start|>assistant")


# pipeline ------------------------------------------------------------------------------------------------------------

FAR = next(i for i in range(303, 400) if zlib.crc32(str(i).encode()) % 3 == 1)  # no training row


def pipeline_docs():
    rnd = random.Random(12)
    docs = [(i, spoken(rnd, lang, 60), lang, "src", None) for i, lang in enumerate(["en", "de", "fr"] * 12)]
    shared = "a line that many documents hold, word for word"
    docs += [(100 + i, f"{spoken(rnd, 'en', 40)}\n{shared}", "en", None, 0) for i in range(5)]
    docs += [(200, docs[0][1], "en", "copy", 0), (201, docs[0][1] + " the", "en", "near", 0), (300, None, "en", "", 0), (301, "", "en", "", 0), (302, "12 34", None, "", 0),
             (FAR, "qx zqj xqz jqx " * 60, "en", "far", 0), (400, "The passage of the test: " + " ".join(f"ing{i}the" for i in range(20)), "en", "", 0), (None, spoken(rnd, "en", 30), "en", "", 0)]
    return docs


def test_pipeline_stages(spark, tmp_path):
    docs = pipeline_docs()
    folder = str(tmp_path)
    spark.createDataFrame(docs, DOCS).coalesce(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"ing{i}the" for i in range(20))), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    table = spark.read.parquet(f"{folder}/documents.parquet")
    before = table
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, folder)
        rows = after.collect()
        held = [(r.doc_id, r.text) for r in before.collect()]
        own = {r.doc_id: r for r in rows}
        if name == "language":
            assert set(own) == {i for i, _ in held} - {300, 301, 302, FAR}
        elif name == "line_dedup":
            assert Counter((r.doc_id, r.text, r.n_chars) for r in rows) == Counter((i, kept, len(kept)) for i, _, _, kept in brute.lines(held))
        elif name == "near_duplicates":
            kept = {i for i, (_, _, k) in brute.near_duplicates([x for x in held if x[0] is not None], 5, 80).items() if k} | {None}
            assert set(own) == kept and not {200, 201} & kept
        elif name == "decontaminate":
            assert set(own) == {i for i, _, _, _, bad in brute.contamination(held, [(1, " ".join(f"ing{i}the" for i in range(20)))]) if not bad}
            assert 400 not in own
        else:
            tool = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                     mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
            for r in rows:
                ids = tool.encode_ordinary(r.text)
                assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(r.text))
        if name != "tokens":
            assert after.columns == table.columns
            after.write.parquet(f"{folder}/{name}")
            before = spark.read.parquet(f"{folder}/{name}")
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == Counter(r.doc_id for r in rows)


def test_pipeline_on_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_crc_split_is_that_of_the_contract(spark):
    got = spark.range(20).select("id", F.crc32(F.col("id").cast("string")).alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in got)
