"""Score transfer by cosine similarity: exact best matches in both directions.

No pair is ever written out.  Both sides are hashed into blocks of bounded size; each task multiplies one block of
targets by one block of sources, a strip at a time, and returns one candidate per row, and a map-side-combined ``max_by``
keeps the best.  A vector travels once per block of the other side, so the block grid, which follows from the sizes of the sides alone, is
shaped to move the fewest vectors for its number of tasks.
Copies of one vector are collapsed to their lowest ordinal first, by a 128-bit hash, so a vector that fills a third of a side is one row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .joins import replace_keys

BLOCK_BYTES = 96 * 2 ** 20   # vectors of one side in one task
STRIP_BYTES = 64 * 2 ** 20   # similarities held at once
TASK_PAIRS = 2 ** 22         # below this many products a further task is not worth its overhead
MOST_TASKS = 4096            # more tasks move more vectors; beyond this only memory makes blocks smaller
NEAREST, WEIGHTED = "cosine_nearest", "cosine_weighted"

#: Fixed value: target codes whose automatic match was audited and replaced by a source code.
AUDITED_MATCHES = {"0011": "33-1012"}


def require_one_dimension(df: DataFrame, vector: str) -> None:
    """An empty side or vectors of several lengths are errors."""
    sizes = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if sizes[0] is None:
        raise ValueError("no embeddings supplied")
    if sizes[0] != sizes[1]:
        raise ValueError(f"embedding dimension mismatch: {sizes[0]} to {sizes[1]}")


def attach_vectors(rows: DataFrame, vectors: DataFrame, text: Column, key: str = "text", vector: str = "embedding",
                   required: bool = False, score: str | None = None) -> DataFrame:
    """Vector per row by its cleaned text.

    Rows without one are dropped, or are an error when ``required``; rows without a usable ``score`` are dropped.
    """
    lookup = vectors.select(F.col(key).alias("_text"), vector)
    keyed = rows.withColumn("_text", text)
    if required:
        missing = keyed.join(lookup, "_text", "left_anti").select("_text").limit(1).collect()
        if missing:
            raise ValueError(f"missing embedding: {missing[0][0]}")
    out = keyed.join(lookup, "_text").drop("_text")
    if score:
        out = out.withColumn(score, F.col(score).try_cast("double")).where(F.col(score).isNotNull())
    require_one_dimension(out, vector)
    return out


def block_grid(sources: int, targets: int, dimension: int) -> tuple[int, int]:
    """Blocks per side.  For a given number of tasks the fewest vectors move when both sides ship the same amount;
    no block may outgrow a task's memory."""
    limit = max(1, BLOCK_BYTES // (8 * max(dimension, 1)))
    tasks = max(1, min(MOST_TASKS, sources * targets // TASK_PAIRS))
    left = max(1, round(math.sqrt(tasks * sources / max(targets, 1))))
    right = max(1, math.ceil(tasks / left))
    return max(left, math.ceil(sources / limit), 1), max(right, math.ceil(targets / limit), 1)


def best_matches(source: DataFrame, target: DataFrame, ordinal: str, vector: str, fold: str | None = None,
                 block_rows: int | None = None) -> DataFrame:
    """``side, ordinal, fold, best, similarity``: the most similar row of the other side for every row.

    ``side='target'`` rows name their best source, ``side='source'`` rows their best target; ties go to the lowest
    ordinal; a zero vector has similarity 0 to everything.  With ``fold`` a target only meets sources of other folds
    and a source has one best target per other fold.
    """
    fold_column = F.col(fold).cast("int") if fold else F.lit(0)
    sides = {}
    for name, df in (("source", source), ("target", target)):
        rows = df.select(F.col(ordinal).cast("long").alias("ordinal"), fold_column.alias("fold"),
                         F.col(vector).cast("array<double>").alias("v"))
        rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
        copies = rows.groupBy("h1", "h2", "fold").agg(F.min("ordinal").alias("first"), F.min_by("v", "ordinal").alias("v"))
        size, dimension = copies.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        sides[name] = (rows.select("ordinal", "fold", "h1", "h2"), copies, size, dimension or 1)
    (_, left, n, dimension), (_, right, m, _) = sides["source"], sides["target"]
    if block_rows:
        left_blocks, right_blocks = max(1, -(-n // block_rows)), max(1, -(-m // block_rows))
    else:
        left_blocks, right_blocks = block_grid(n, m, dimension)
    own = lambda n: F.pmod(F.xxhash64("first"), F.lit(n)).cast("int")
    all_blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    placed = (
        left.select(own(left_blocks).alias("i"), all_blocks(right_blocks).alias("j"), F.lit(True).alias("is_source"),
                    "first", "fold", "v")
        .unionByName(
            right.select(all_blocks(left_blocks).alias("i"), own(right_blocks).alias("j"),
                         F.lit(False).alias("is_source"), "first", "fold", "v"))
    )
    schema = "is_source boolean, first long, fold int, best long, similarity double"
    candidates = placed.groupBy("i", "j").applyInArrow(_block_kernel(fold is not None), schema)
    best = candidates.groupBy("is_source", "first", "fold").agg(
        F.max_by(F.struct("best", "similarity"), F.struct(F.col("similarity"), -F.col("best"))).alias("b")
    ).select("is_source", "first", "fold", "b.*")

    out = []
    for name, (rows, copies, _, _) in sides.items():
        is_source = name == "source"
        # copies of one vector share the answer of the lowest ordinal
        members = rows.join(copies.select("h1", "h2", "fold", "first"), ["h1", "h2", "fold"]).select("ordinal", "first")
        out.append(
            members.join(best.where(F.col("is_source") == is_source).drop("is_source"), "first")
            .select(F.lit(name).alias("side"), "ordinal", "fold", "best", "similarity")
        )
    return out[0].unionByName(out[1])


def _block_kernel(folds: bool):
    def run(table: pa.Table) -> pa.Table:
        is_source = table.column("is_source").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("first").to_numpy()
        groups = table.column("fold").to_numpy()
        column = table.column("v").combine_chunks()
        matrix = column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        unit = np.divide(matrix, norms[:, None], out=np.zeros_like(matrix), where=norms[:, None] > 0)
        order = np.argsort(ids, kind="stable")
        s, t = order[is_source[order]], order[~is_source[order]]
        parts = []
        for f in (np.unique(groups[t]) if folds else [None]) if len(s) and len(t) else []:
            rows = t if f is None else t[groups[t] == f]
            cols = s if f is None else s[groups[s] != f]
            if not len(rows) or not len(cols):
                continue
            near, near_sim = np.empty(len(rows), dtype=int), np.empty(len(rows))
            far, far_sim = np.zeros(len(cols), dtype=int), np.full(len(cols), -np.inf)
            right = unit[cols].T
            strip = max(1, STRIP_BYTES // (8 * len(cols)))
            for start in range(0, len(rows), strip):
                sims = unit[rows[start:start + strip]] @ right
                here = sims.argmax(axis=1)
                near[start:start + len(sims)], near_sim[start:start + len(sims)] = here, sims[np.arange(len(sims)), here]
                top = sims.argmax(axis=0)
                value = sims[top, np.arange(len(cols))]
                better = value > far_sim  # strict: an earlier strip has the lower ordinals
                far[better], far_sim[better] = top[better] + start, value[better]
            label = 0 if f is None else int(f)
            parts.append((False, ids[rows], label, ids[cols[near]], near_sim))
            parts.append((True, ids[cols], label, ids[rows[far]], far_sim))
        size = [len(p[1]) for p in parts]
        cat = lambda k, dtype: np.concatenate([p[k] for p in parts]).astype(dtype) if parts else np.empty(0, dtype)
        rep = lambda k, dtype: np.repeat(np.array([p[k] for p in parts], dtype), size) if parts else np.empty(0, dtype)
        return pa.table({
            "is_source": pa.array(rep(0, bool)), "first": pa.array(cat(1, np.int64)),
            "fold": pa.array(rep(2, np.int32)), "best": pa.array(cat(3, np.int64)),
            "similarity": pa.array(cat(4, np.float64)),
        })

    return run


def nearest_scores(matches: DataFrame, source: DataFrame, ordinal: str, score: str) -> DataFrame:
    """``ordinal, fold`` of each target with the score of its most similar source."""
    lookup = source.select(F.col(ordinal).alias("best"), F.col(score).alias(NEAREST))
    return matches.where("side = 'target'").join(lookup, "best").select("ordinal", "fold", NEAREST)


def weighted_scores(matches: DataFrame, source: DataFrame, ordinal: str, score: str) -> DataFrame:
    """Each source goes to its most similar target; a target takes the similarity-weighted mean of what it got.

    Targets that got nothing, or a weight of 0 or less, fall back to the nearest source.
    """
    given = source.select(F.col(ordinal).alias("ordinal"), F.col(score).alias("_y"))
    received = matches.where("side = 'source'").join(given, "ordinal").groupBy(F.col("best").alias("ordinal"), "fold").agg(
        F.sum(F.col("similarity") * F.col("_y")).alias("_num"), F.sum("similarity").alias("_den")
    )
    near = nearest_scores(matches, source, ordinal, score)
    value = F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(F.col(NEAREST))
    return near.join(received, ["ordinal", "fold"], "left").select("ordinal", "fold", NEAREST, value.alias(WEIGHTED))


def match_pairs(matches: DataFrame) -> DataFrame:
    """``method, target, source, similarity`` behind both transfers; the weighted list falls back to the nearest
    source only where a target was assigned none."""
    near = matches.where("side = 'target'").select(
        F.lit(NEAREST).alias("method"), F.col("ordinal").alias("target"), F.col("best").alias("source"), "similarity"
    )
    given = matches.where("side = 'source'").select(
        F.lit(WEIGHTED).alias("method"), F.col("best").alias("target"), F.col("ordinal").alias("source"), "similarity"
    )
    lonely = near.join(given.select("target").distinct(), "target", "left_anti").withColumn("method", F.lit(WEIGHTED))
    return near.unionByName(given).unionByName(lonely)


def match_table(matches: DataFrame, source: DataFrame, target: DataFrame, ordinal: str, score: str,
                source_columns: dict[str, str], target_columns: dict[str, str]) -> DataFrame:
    """Match pairs with the describing columns of both sides."""
    left = target.select(F.col(ordinal).alias("target"), *[F.col(c).alias(n) for c, n in target_columns.items()])
    right = source.select(F.col(ordinal).alias("source"), F.col(score).alias("source_score"),
                          *[F.col(c).alias(n) for c, n in source_columns.items()])
    return match_pairs(matches).join(left, "target").join(right, "source").withColumnRenamed(
        "similarity", "cosine_similarity")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns; 0 when either is a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def audited_pairs(source: DataFrame, target: DataFrame, overrides: dict[str, str], source_code: str,
                  target_key: str) -> DataFrame:
    """Overridden target keys with their prescribed source code, where both exist."""
    pairs = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    wanted = target.withColumn("_code", F.try_element_at(pairs, F.col(target_key).cast("string")))
    return wanted.where(F.col("_code").isNotNull())


def override_scores(scores: DataFrame, source: DataFrame, overrides: dict[str, str], target_key: str,
                    source_code: str, score: str, columns: list[str]) -> DataFrame:
    """Replace the scores of audited targets by the score of the prescribed source, if that source exists."""
    given = source.where(F.col(source_code).isin(*overrides.values())).select(
        F.col(source_code).alias("_code"), F.col(score).alias("_given"))
    pairs = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    keyed = scores.withColumn("_code", F.try_element_at(pairs, F.col(target_key).cast("string")))
    joined = keyed.join(given, "_code", "left")
    return joined.select(*[
        F.coalesce("_given", c).alias(c) if c in columns else F.col(c) for c in scores.columns
    ])


def override_pairs(pairs: DataFrame, source: DataFrame, target: DataFrame, overrides: dict[str, str], ordinal: str,
                   vector: str, target_key: str, source_code: str) -> DataFrame:
    """Replace the match pairs of audited targets by their prescribed source, for every method present."""
    src = source.where(F.col(source_code).isin(*overrides.values())).select(
        F.col(source_code).alias("_code"), F.col(ordinal).alias("source"), F.col(vector).alias("_sv"))
    tgt = audited_pairs(source, target, overrides, source_code, target_key).select(
        "_code", F.col(ordinal).alias("target"), F.col(vector).alias("_tv"))
    forced = tgt.join(src, "_code").select("target", "source", cosine(F.col("_tv"), F.col("_sv")).alias("similarity"))
    methods = F.explode(F.array(F.lit(NEAREST), F.lit(WEIGHTED)))
    return replace_keys(pairs, forced.select(methods.alias("method"), "target", "source", "similarity"),
                        ["method", "target"])


def assemble(targets: DataFrame, key: str, *methods: DataFrame) -> DataFrame:
    """One score column per chosen method, joined on the target key."""
    out = targets
    for m in methods:
        out = out.join(m, key, "left")
    return out


def cross_validate(rows: DataFrame, ordinal: str, vector: str, score: str, fold: str) -> DataFrame:
    """MAE, RMSE and R2 of the global mean and both cosine transfers, all folds in one pass.

    Rows of a fold play the targets of every other fold's rows.
    """
    from .panel import error_metrics

    matches = best_matches(rows, rows, ordinal, vector, fold)
    cosines = weighted_scores(matches, rows, ordinal, score).drop("fold")
    total = rows.agg(F.sum(score).alias("_s"), F.count(score).alias("_n"))
    sums = rows.groupBy(fold).agg(F.sum(score).alias("_fs"), F.count(score).alias("_fn"))
    means = sums.select(fold, F.try_divide(total.select("_s").scalar() - F.col("_fs"),
                                           total.select("_n").scalar() - F.col("_fn")).alias("global_mean"))
    joined = rows.select(F.col(ordinal).alias("ordinal"), fold, score).join(means, fold).join(cosines, "ordinal")
    long = joined.select(score, F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(m).alias("prediction")) for m in ("global_mean", WEIGHTED, NEAREST)
    ])).alias("p")).select(score, "p.*")
    return error_metrics(long, score, "prediction", ["method"])


def hash_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """Deterministic fold label from the key; no global ordering needed."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)).cast("int"))
