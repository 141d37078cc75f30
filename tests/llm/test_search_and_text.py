"""Decontamination, exact top-k, page text, token counts and BPE against plain versions."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import contamination, sha
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelloom.llm import bpe, decontaminate, html, tokencount, topk

RANKS, JSON = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
ODD_TEXTS = [None, "", " ", "a", "Ä", "\n\n", "x" * 5000, "ab " * 30_000, "don't<|endoftext|> 日本 \U0001f600\t12345   ", "a", "a", None]


def random_text(rnd, words, n):
    return " ".join(rnd.choice(words) + rnd.choice(["", ",", "É", "7"]) for _ in range(n))


@pytest.mark.parametrize("block_words", [1_000_000, 12])
def test_decontamination_equals_brute_force(spark, block_words):
    rnd = random.Random(block_words)
    words = ["the", "Of", "ab", "é", "x1"]
    docs = [(i, random_text(rnd, words, rnd.randint(0, 80))) for i in range(60)] + [(None, "the of ab"), (7, None), (8, ""), (8, "")]
    items = [(i % 7, random_text(rnd, words, rnd.randint(0, 12))) for i in range(12)] + [(None, "the of"), (50, None), (51, ""), (52, docs[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"N_words": F.lit("mine"), "hits": F.lit(1)})
    marked = decontaminate.annotate(frame, spark.createDataFrame(items, "item_id long, text string"), window=3, block_words=block_words)
    assert marked.columns == ["doc_id", "text", "N_words", "hits", "n_words_", "n_hit", "hits_", "items", "contaminated"]
    got = sorted((r.doc_id, r.n_words_, r.n_hit, tuple(r["items"]), r.contaminated) for r in marked.collect() if r.doc_id is not None)
    want = sorted((a, b, c, tuple(d), e) for a, b, c, d, e in contamination(docs, items, 3) if a is not None)
    assert got == want
    assert {r.N_words for r in marked.collect()} == {"mine"}


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.annotate(docs, items).collect() == []
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate.annotate(one, items).collect()] == [(2, 0, False)]
    assert decontaminate.remove_contaminated(one, one.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_longest_matches(spark):
    docs = spark.createDataFrame([(2, "a b c d e"), (1, "x b c d y"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "b c d e"), ("r", "zz"), ("s", None)], "item_id string, text string")
    got = {(r.item_id, r.item_start): (r.length, r.doc_id, r.doc_start) for r in decontaminate.longest_matches(docs, items).collect()}
    assert got == {("q", 0): (4, 2, 1), ("q", 1): (3, 2, 2), ("q", 2): (2, 2, 3), ("q", 3): (1, 2, 4)}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(120, 6)).astype(np.float32)
    data[40:80] = data[40]  # many ties
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (None, [1.0] * 6),
           (510, [1.0, 2.0]), (520, [3.0, -1.0]), rows[5], rows[5]]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine"))
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 10 == 0, k=5, least_rows=16).collect())
    whole = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in rows}
    want = []
    for q in range(0, 120, 10):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    two = {510: np.array([256, 512]), 520: np.array([768, -256])}
    want += [(a, 1, b, int(two[a] @ two[b])) for a, b in ((510, 520), (520, 510))]
    assert got == sorted(want)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_block_top_is_exact_for_large_components():
    rng = np.random.default_rng(1)
    for size in (3, 1 << 25, 1 << 30):
        data = rng.integers(-size, size, (50, 20))
        ids = np.arange(50)
        want = [(q, i, -s) for q in range(5) for s, i in sorted((-sum(int(a) * int(b) for a, b in zip(data[q], data[i])), i) for i in range(50) if i != q)[:3]]
        assert topk.block_top(ids[:5], data[:5], ids, data, 3) == want


PAGES = {
    "<p>One &amp; two<p>Three&nbsp; four<br>five": "One & two\n\nThree four five",
    "<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>Text, of the <b>article</b>.<p>More &lt;text&gt;.</article><footer>End</footer>":
        "Title\n\nText, of the article.\n\nMore <text>.",
    "<div class='wrap'><div class='sidebar'><p>Side, text, with many, many commas, that is long enough.</p></div><div id='content'>"
    "<p>Main text, which is long enough to be counted, of course.</p><p>End.</p></div><div class='comments-area'><p>Reader, says, this, that.</p></div></div>":
        "Main text, which is long enough to be counted, of course.\n\nEnd.",
    "<main><p>Body.</p><form><label>Name</label></form><aside>x</aside><div class='cookie-notice'>Cookies</div><script>if (a < b) '</p>'</script></main>": "Body.",
    "plain &am text < here": "plain &am text < here", "<script>x": "", "": "", "<!-- a <p>b</p> -->c": "c",
    "<table><tr><td>One cell<td>two</table>": "One cell\n\ntwo",
    "<form id=aspnetForm><nav>x</nav><article><p>One, two.</p></article><div class=newsletter><p>Sign up, now.</p></div></form>": "One, two.",
    "<div class='content-sidebar-wrap'><article><p>One, two.</p><p class='related-work'>Three.</p><p class=ad>Buy.</p></article></div>": "One, two.\n\nThree.",
    "<div id='main-menu-wrapper'><article><p>One, two.</p><div class='share-box'>Share</div></article><div class='sidebar'><p>Side.</p></div></div>": "One, two.",
    "<article><p>One, two.</p><div id=comments><article class=comment-body><p>" + "I think, that, this, is, long, and, so on, and on. " * 9 + "</p></article></div></article>":
        "One, two.",
    "<form><p>Text of a page, all of which, lies in a form.</p><fieldset><p>Name</p></fieldset></form>": "Text of a page, all of which, lies in a form.",
}


def test_page_text(spark):
    rows = [(i, "u", page) for i, page in enumerate(PAGES)] + [(90, None, None), (None, "u", ""), (91, "u", "<p>" + "word, " * 50_000)]
    out = html.extract(spark.createDataFrame(rows, "page_id long, text string, html string"))
    assert out.columns == ["page_id", "text", "text_", "n_chars"]
    got = {r.page_id: (r.text_, r.n_chars) for r in out.collect()}
    for i, want in enumerate(PAGES.values()):
        assert got[i] == (want, len(want))
    assert got[90] == ("", 0) and got[None] == ("", 0) and got[91][1] == 6 * 50_000 - 1
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_long_bare_page_is_read_in_linear_time():
    assert html.main_text("<" * 50_000 + "p>x") is not None and len(html.main_text("<p>a" * 20_000)) == 3 * 20_000 - 2


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library(spark):
    frame = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string").withColumn("IDS", F.lit(3))
    out = bpe.encode(frame, RANKS, public_tokenizers.PATTERN)
    assert out.columns == ["doc_id", "text", "IDS", "ids_", "decoded"]
    tool = library()
    for r in out.collect():
        want = tool.encode_ordinary(r.text or "")
        assert np.frombuffer(bytes(r["ids_"]), "<u4").tolist() == want and r.decoded == (r.text or "")
    told = {r.doc_id: r for r in bpe.digests(bpe.encode(frame.drop("IDS"), RANKS, public_tokenizers.PATTERN), ["doc_id"]).collect()}
    assert told[0].n_tokens == 0 and told[0].ids_sha256 == told[0].decoded_sha256 == sha("")
    assert bpe.encode(frame.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_a_long_piece_is_encoded_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 2_000)
    machine, tool, rnd = bpe.Transducer(bpe.read_ranks(RANKS)), library(), random.Random(8)
    piece = "".join(rnd.choice("etaoinshrdluQZ") for _ in range(200_000))
    assert machine.encode(piece.encode()) == tool.encode_ordinary(piece)
    assert len(machine._states) <= 2_002


def test_transducer_on_random_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 300)
    monkeypatch.setattr(bpe, "PIECES", 50)
    codec, tool, rnd = bpe.Codec(RANKS, public_tokenizers.PATTERN), library(), random.Random(5)
    alphabets = ["abcdefghij", "etaoinshr ", "  \n\t'sdtl", "0123456789", "日éü\U0001f600", "=-_*#/"]
    for i in range(3000):
        text = "".join(rnd.choice(rnd.choice(alphabets) if i % 2 else alphabets[i // 2 % 6]) for _ in range(rnd.randint(1, 40)))
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == tool.encode_ordinary(text)
        assert "".join(codec.decode_stream(packed, block=1)) == text


def test_utf8_stream_on_invalid_bytes():
    rnd = random.Random(2)
    for _ in range(2000):
        data = bytes(rnd.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0, 0xC0]) for _ in range(rnd.randint(0, 12)))
        stream = bpe.Utf8Stream()
        assert "".join(stream.feed(data[i:i + 1]) for i in range(len(data))) + stream.close() == data.decode("utf-8", "replace")


@pytest.mark.parametrize("chunk, overlap", [(32_768, 1_024), (60, 24)])
def test_token_counts_equal_the_library(spark, chunk, overlap):
    rnd = random.Random(chunk)
    texts = list(ODD_TEXTS)
    for _ in range(25):
        texts.append("".join(rnd.choice(["<|endoftext|>", " " * rnd.randint(1, 90), "x" * rnd.randint(1, 200), "word's ", "日é ", "12 ", "\n"]) for _ in range(60)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("N_tokens", F.lit("mine"))
    out = tokencount.count_tokens(frame, JSON, chunk=chunk, overlap=overlap)
    tool = Tokenizer.from_file(JSON)
    got = {r.doc_id: r.n_tokens_ for r in out.collect()}
    assert got == {i: len(tool.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
    assert tokencount.count_tokens(frame.limit(0), JSON).collect() == []


def test_pieces_count_like_the_library(monkeypatch):
    monkeypatch.setattr(tokencount, "PIECES_HELD", 500)
    rnd = random.Random(5)
    letters = [chr(c) for c in range(0x250) if not 0x7f < c < 0x85] + list("     \n\n''stdlvrem''09ſ日本ͰΩ 　\U0001f600\x1c\x85\xa0")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["w" * 300, "<|endoftext|> a", "it's we'LL  \t\n x"]
    count = tokencount.Counter(JSON)
    tool = Tokenizer.from_file(JSON)
    want = [tool.encode(t, add_special_tokens=False) for t in texts]
    assert count.count(texts) == [len(e) for e in want]
    for text, e in zip(texts, want):
        n, at, before = count.starts(text) if text else (0, [], [])
        places = {}
        for i, (word, (start, _)) in enumerate(zip(e.word_ids, e.offsets)):
            places.setdefault(word, (start, i))
        assert n == len(e) and list(zip(at, before)) == list(places.values())


def test_guard_declines_what_it_does_not_know(tmp_path):
    import json
    said = json.load(open(JSON))
    for change in ({"post_processor": {"type": "ByteLevel", "trim_offsets": True}}, {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}):
        (tmp_path / "t.json").write_text(json.dumps(said | change))
        assert tokencount.guard(str(tmp_path / "t.json")) is None
    assert tokencount.guard(JSON) == 15
