"""Nearest neighbours by additive quantisation: every codebook spans all dimensions, codes are found by beam search
over the residual codebooks, the norm of each reconstruction is stored, candidates are scored from lookup tables, and
the shortlist is ranked again by exact distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspan.llm._common import arrow_batches, table, written

#: Codebooks, codewords in each, beams kept while encoding, and how many candidates a block of codes hands on for each query.
BOOKS, WORDS, BEAMS, SHORTLIST = 24, 256, 4, 100
#: The codebooks are fitted on about this many vectors at most, chosen by a hash; all vectors are indexed.
TRAINING_VECTORS = 8192
QUERY_BLOCK, CODE_BLOCK = 1024, 16384


def _single(vectors) -> np.ndarray:
    """Rows in single precision; what is beyond its range for squares is at its end."""
    return np.clip(np.stack(list(vectors)), -1e15, 1e15).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, 1)
        order = np.argsort(near, kind="stable")
        ids, starts = np.unique(near[order], return_index=True)
        centres[ids] = np.add.reduceat(x[order], starts) / np.diff(np.append(starts, len(x)))[:, None]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beams: int = BEAMS) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n x books) and squared norms of the reconstructions, by beam search."""
    n, (m, k, d) = len(x), books.shape
    rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for book in books:
        width = rest.shape[1]
        error = (rest**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * rest @ book.T
        flat = error.reshape(n, width * k)
        keep = min(beams, width * k)
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), 1, kind="stable"), 1)
        beam, word = best // k, best % k
        rest = np.take_along_axis(rest, beam[:, :, None], 1) - book[word]
        codes = np.concatenate((np.take_along_axis(codes, beam[:, :, None], 1), word[:, :, None].astype(np.uint8)), 2)
    return codes[:, 0], ((x - rest[:, 0]) ** 2).sum(1)


def fit(vectors: DataFrame, books: int = BOOKS, words: int = WORDS, training_vectors: int = TRAINING_VECTORS, seed: int = 3) -> np.ndarray | None:
    """Residual codebooks (books x words x dimensions), from a bounded sample that the driver gets; None without vectors."""
    n = vectors.count()
    share = min(1.0, training_vectors / max(1, n))
    sample = vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20) + 1)).orderBy("vec_id").select("v").toPandas()["v"]
    if not len(sample):
        return None
    x = _single(sample)
    rng, out = np.random.default_rng(seed), []
    rest = x
    for _ in range(books):
        k = min(words, len(x))
        out.append(_kmeans(rest, k, rng))
        near = np.concatenate([np.argmin((out[-1] ** 2).sum(1) - 2 * rest[i : i + 4096] @ out[-1].T, 1) for i in range(0, len(rest), 4096)])
        rest = rest - out[-1][near]
    return np.stack(out)


def nearest(df: DataFrame, queries: "F.Column | None" = None, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that `queries` selects its `k` nearest others by Euclidean
    distance, nearest first, ties to the smaller id.

    Every block's shortlist is ranked exactly, with all that ties with its last one and all vectors of the same codes.
    Rows with a null id, and vectors that are null, empty, zero, of another length than most or hold null or non-finite
    components take no part. Rows repeated in full count once. Too few candidates give fewer rows; an empty table none.
    """
    spark = df.sparkSession
    arrow_batches(spark, 4096)
    # exact distances are those of the vectors as they are; only codes are made in single precision
    single = df.schema[vector_column].dataType.simpleString() == "array<float>"
    v = df[vector_column].cast("array<float>" if single else "array<double>")
    rows = df.select(df[id_column].cast("long").alias("vec_id"), v.alias("v"), (queries if queries is not None else df[id_column] % 100 == 0).alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = written(rows.filter(F.size("v") == usual["d"]).withColumn("vh", F.xxhash64("v")), "vectors")
    books = fit(rows)
    shared = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _single([y.values.to_numpy() for y in part.column(2)])
                codes, norms = encode(x, shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32())], ["vec_id", "vh", "code", "norm"])

    index = written(rows.select("vec_id", "vh", "v").mapInArrow(coded, "vec_id long, vh long, code binary, norm float"), "index")
    # of equal vectors no more than the smallest ids can be among the nearest of any query
    copies = W.partitionBy("vh").orderBy("vec_id")
    index = index.dropDuplicates(["vec_id", "vh"]).withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    index = written(index, "distinct")
    asked = rows.filter("q").select(F.col("vec_id").alias("query_id"), F.col("vh").alias("query_vh"), "v").distinct()
    asked = written(asked, "queries")
    # blocks of queries against blocks of codes, each pair one group of a bounded size
    n_q, n_c = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-index.count() // CODE_BLOCK))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    right = index.withColumn("cb", F.pmod(F.xxhash64("vec_id"), F.lit(n_c)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "query_vh": [], "code": []}
        c = c.drop_duplicates(["vec_id", "vh"]).sort_values(["vec_id", "vh"])
        if not len(q) or not len(c):
            return pd.DataFrame(out)
        books, codes = shared.value, np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1)
        ids, norms = c["vec_id"].to_numpy(), c["norm"].to_numpy(np.float32)
        for at in range(0, len(q), 64):
            part = q.iloc[at : at + 64]
            x = _single(part["v"])
            tables = -2 * np.einsum("qd,mkd->mqk", x, books, optimize=True)
            scores = np.broadcast_to(norms, (len(x), len(c))).copy()
            for t, own in zip(tables, codes.T, strict=True):
                scores += t[:, own]
            scores[part["query_id"].to_numpy()[:, None] == ids[None, :]] = np.inf
            # scores that single precision cannot tell from that of the last one kept tie with it
            slack = 32 * np.finfo(np.float32).eps * (norms + (x**2).sum(1)[:, None])
            edge = np.partition(scores, min(shortlist, len(c)) - 1, axis=1)[:, min(shortlist, len(c)) - 1, None]
            for i, row in enumerate(np.isfinite(scores) & (scores <= edge + slack)):
                # codes, not ids: all vectors of a code tie, also those of other blocks
                own = np.unique(codes[row], axis=0)
                out["query_id"].append(np.full(len(own), part["query_id"].iloc[i]))
                out["query_vh"].append(np.full(len(own), part["query_vh"].iloc[i]))
                out["code"].append(np.array([x.tobytes() for x in own], object))
        return pd.DataFrame({k: np.concatenate(x) for k, x in out.items()})

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(score, "query_id long, query_vh long, code binary").distinct()
    own = W.partitionBy("query_id", "query_vh")
    short = found.join(index.select("code", "vec_id", "vh"), "code").filter(F.col("query_id") != F.col("vec_id")).drop("code")
    full = rows.select("vec_id", "vh", F.col("v").alias("cv"))
    exact = short.join(full, ["vec_id", "vh"]).dropDuplicates(["query_id", "query_vh", "vec_id", "vh"]).join(asked, ["query_id", "query_vh"])
    square = F.aggregate(F.zip_with("v", "cv", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, b: a + b)
    ranked = exact.withColumn("score", F.sqrt(square)).withColumn("rank", F.row_number().over(own.orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_nearest_neighbours": op7_nearest_neighbours}
