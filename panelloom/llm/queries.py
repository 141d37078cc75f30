"""The registered queries of this subpackage: each applies one operator to its whole table and derives digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, centroids, chat, decontaminate, html, importance, langid, lines, neardup, substrings, tokencount, topk, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of 13 words in every document, by suffix arrays."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = decontaminate.annotate(docs, table(spark, folder, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every document by the rank file, decode the ids, and return the digests of both."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(docs, path, public_tokenizers.PATTERN), ["doc_id"])


@query
def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 largest inner products of every 50th vector with all others."""
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op6_langid(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document; learned from two thirds of the ids."""
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.fit(docs.where(~held_out), F.col("doc_id"))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def labelled(labels: DataFrame, bound: int = 12_000) -> tuple[DataFrame, dict[int, int]]:
    """At most ``bound`` labelled ids, by the hash of the id within each label, and how many there are of each label.

    The rarer label comes whole up to half the bound; the other one fills the rest.
    """
    rows = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    sizes = {row.toxic: row.n for row in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    zeros, ones = sizes.get(0, 0), sizes.get(1, 0)
    ones = min(ones, max(bound // 2, bound - zeros))
    part = lambda toxic, n: rows.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return part(0, min(zeros, bound - ones)).unionByName(part(1, ones)), sizes


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document from labelled examples of four fifths of the ids (at most 12,000, see ``labelled``)."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    chosen, sizes = labelled(table(spark, folder, "labels").where(~held_out))
    examples = docs.join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").alias("name"), "text", F.col("toxic").alias("label")) \
        .groupBy("name", "label").agg(F.min("text").alias("text"))
    model = toxicity.fit(examples, bound=12_000, of=sizes)
    return toxicity.score(docs.withColumn("held_out", held_out), model, evidence=False).select("doc_id", "held_out", "score", "predicted")


@query
def op3_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, folder, "pages").select("page_id", "url", "html"))


@query
def op5_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, Jaccard of 85 in a hundred."""
    return neardup.near_duplicates(table(spark, folder, "documents"), neardup.Settings(words=3, percent=85))


@query
def op2_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that three documents or more share, dropped but for the document with the largest id."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = lines.drop_repeated_lines(docs, lines.file_batches(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op2_lines"] = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS rows FROM documents),
line AS (SELECT doc_id, unnest(rows) AS line, unnest(range(len(rows))) AS place FROM split),
keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM line),
repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, coalesce(doc_id < last, false) AS dropped FROM keyed k LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

ORACLES["op10_topk"] = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT::DOUBLE FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

ORACLES["op1_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(greatest(1, len(w) - 12))) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, w[p + 1:p + 13] AS win, least(13, len(w)) AS size FROM starts),
sizes AS (SELECT DISTINCT size FROM win),
places AS (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS p FROM d JOIN sizes ON len(w) >= size),
hits AS (SELECT DISTINCT doc_id, p, size, item_id FROM (SELECT doc_id, p, size, w[p + 1:p + size] AS win FROM places) JOIN win USING (win, size)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query
def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation from the perspective of each of its speakers."""
    return chat.rotate(table(spark, folder, "conversations"))


ORACLES["op4_chat"] = r"""
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE conv_id IS NOT NULL AND role IS NOT NULL AND role <> 'system'),
said AS (SELECT conv_id, speaker, place // 512 AS part, place, coalesce(role = speaker, false) AS own,
    CASE WHEN role = speaker THEN '<|im_start|>assistant' WHEN role = 'system' THEN '<|im_start|>system'
        ELSE '<|im_start|>user name=' || coalesce(role, 'unknown') END || chr(10) AS head, coalesce(text, '') || '<|im_end|>' AS body
    FROM placed JOIN speakers USING (conv_id)),
spans AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY place
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begin_at FROM said)
SELECT conv_id, speaker, part, count(*) AS n_messages, string_agg(head || body || chr(10), '' ORDER BY place) AS rendered,
    coalesce(string_agg(begin_at::BIGINT || '-' || (begin_at + length(body))::BIGINT, ',' ORDER BY place) FILTER (WHERE own), '') AS mask,
    coalesce(sum(length(body)) FILTER (WHERE own), 0)::BIGINT AS n_learned
FROM spans GROUP BY conv_id, speaker, part"""


@query
def op7_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token count of every document, and whether it exceeds 1,024."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = tokencount.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
                        (F.col("n_tokens") > 1024).alias("over_limit"))


ORACLES["op5_neardup"] = r"""
WITH RECURSIVE plain AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents),
words AS (SELECT doc_id, t, string_split(t, ' ') AS w FROM plain),
shingle AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN t ELSE w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] END AS s
    FROM (SELECT *, unnest(range(greatest(1, len(w) - 2))) AS p FROM words WHERE t <> '')),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.other = e.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN size USING (doc_id)"""


@query
def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn towards the word windows of the benchmark."""
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), importance.Settings()).drop("n_words")


ORACLES["op11_importance"] = r"""
WITH crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
of_docs AS (SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS f FROM d),
of_items AS (SELECT unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS f FROM b),
feature AS (SELECT f, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(len(h) // 2)]),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT f, hex(f) AS h FROM (SELECT f FROM of_docs UNION SELECT f FROM of_items)), crc_table),
have AS (SELECT doc_id, bucket FROM of_docs JOIN feature USING (f)),
s AS (SELECT bucket, count(*) AS s FROM have GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM of_items JOIN feature USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (sum(s) OVER () + 10000)
    / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS g FROM have JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN weighed USING (doc_id)),
final AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM final WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM final LEFT JOIN placed USING (doc_id)"""


@query
def op12_substrings(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 50 words that a document with a smaller id has, removed from every document."""
    found = substrings.repeated_passages(table(spark, folder, "documents"), words=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op12_substrings"] = r"""
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(len(w) - 49)) AS p FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, p, w[p + 1:p + 50] AS win FROM starts),
first AS (SELECT win, min(doc_id) AS first FROM win GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, p FROM win JOIN first USING (win) WHERE doc_id > first),
covered AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM gone),
lost AS (SELECT doc_id, count(*) AS n, list(q) AS places FROM covered GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS q FROM d JOIN lost USING (doc_id)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t FROM word LEFT JOIN covered USING (doc_id, q) WHERE covered.q IS NULL GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
    sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query
def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """16 clusters of all embeddings after three rounds, with inertia."""
    found, final = centroids.cluster(table(spark, folder, "embeddings"), centroids.Settings())
    return centroids.with_inertia(found.drop("compared"), final)


def _centroid_rounds(rounds: int) -> str:
    """The SQL of ``rounds`` rounds: a table c<r> of centroids (cluster, c) and a table a<r> of assignments to them."""
    steps = []
    for r in range(rounds + 1):
        if r:
            steps.append(f"""m{r} AS (SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, floor(sum(x) / count(*))::DOUBLE AS m
    FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r - 1}) GROUP BY cluster, i) GROUP BY cluster),
c{r} AS (SELECT cluster, coalesce(m{r}.c, c{r - 1}.c) AS c FROM c{r - 1} LEFT JOIN m{r} USING (cluster))""")
        steps.append(f"""a{r} AS (SELECT row_id, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(distance, cluster)).cluster AS cluster,
    min(distance) AS distance FROM (SELECT row_id, vec_id, v, cluster, (list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c))::BIGINT AS distance
    FROM kept JOIN c{r} ON true) GROUP BY row_id)""")
    return ",\n".join(steps)


ORACLES["op13_centroids"] = f"""
WITH kept AS (SELECT row_number() OVER () AS row_id, vec_id, [floor(64 * x::DOUBLE)::DOUBLE FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS cluster, v AS c FROM (SELECT v, sha256('1:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT 16)),
{_centroid_rounds(3)}
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
    sha256(array_to_string([x::BIGINT FOR x IN c], ',')) AS centroid_sha256 FROM a3 JOIN c3 USING (cluster)"""
