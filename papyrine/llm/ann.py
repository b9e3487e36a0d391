"""Approximate nearest neighbours by inner product.

Method: product quantisation with sixteen centroids a subspace (four-bit codes), trained with a
score-aware loss in which the part of the residual parallel to the vector weighs more than the part
across it, because that part is what changes large inner products. A query's scores of all codes are
sums of table look-ups; the best candidates are then scored exactly on the original vectors.

The codebook is fitted on a bounded sample; every row is encoded, once, and scanned. Equal vectors are one
entry with its smallest ids. Queries meet the codes in blocks: a task holds one block of queries and one
block of codes (a quarter of a byte a dimension), so its memory is fixed and vectors do not travel with
them. The best candidates of a query over all blocks are then joined with the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.llm._shared import Scratch, shuffle_parts, small_batches, stored

#: Rows that the codebook is fitted on, at most; a documented bound, not a limit on what is indexed.
SAMPLE_ROWS = 16_384
CENTROIDS = 16
#: Dimensions of one subspace.
SUB = 2
#: Weight of the parallel part of the residual over the orthogonal part.
ANISOTROPY = 4.0
#: Queries of a share; codes of a block, at least and at most; pairs of a unit of both, where the bounds allow.
SHARE_QUERIES = 8192
BLOCK_ROWS = (4096, 1 << 20)
UNIT_PAIRS = 1 << 25
#: Candidates of a query that are scored exactly.
RERANK = 640
#: Queries up to this number are broadcast to their candidates (8 bytes a dimension each); more are joined by shuffling.
BROADCAST_QUERIES = 50_000
#: Queries whose tables a worker holds at once.
CHUNK = 64


def fit_codebook(vectors: np.ndarray, *, sub: int = SUB, eta: float = ANISOTROPY, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centroids, shaped subspaces x 16 x sub, that lower the anisotropic loss of unit directions.

    For a subspace the loss of coding x by c is |x - c|^2 + (eta - 1) <x - c, u>^2 with u the part of
    the row's own direction in it; the update of a centroid solves the weighted normal equations.
    """
    rng = np.random.default_rng(seed)
    n, dims = vectors.shape
    padded = np.pad(vectors, ((0, 0), (0, -dims % sub)))
    unit = padded / np.maximum(np.linalg.norm(padded, axis=1, keepdims=True), 1e-12)
    books = np.zeros((padded.shape[1] // sub, CENTROIDS, sub))
    for m in range(len(books)):
        x, u = padded[:, m * sub : (m + 1) * sub], unit[:, m * sub : (m + 1) * sub]
        c = x[rng.choice(n, CENTROIDS, replace=n < CENTROIDS)].copy()
        outer = np.eye(sub) + (eta - 1) * u[:, :, None] * u[:, None, :]
        target = np.einsum("nij,nj->ni", outer, x)
        for _ in range(rounds):
            code = anisotropic_codes(x, u, c, eta)
            for k in range(CENTROIDS):
                own = code == k
                if own.any():
                    c[k] = np.linalg.solve(outer[own].sum(0), target[own].sum(0))
        books[m] = c
    return books


def anisotropic_codes(x: np.ndarray, u: np.ndarray, c: np.ndarray, eta: float) -> np.ndarray:
    apart = x[:, None, :] - c[None]
    return ((apart**2).sum(2) + (eta - 1) * np.einsum("nkj,nj->nk", apart, u) ** 2).argmin(1)


def encode(vectors: np.ndarray, books: np.ndarray, eta: float = ANISOTROPY) -> np.ndarray:
    """Two codes a byte: rows x ceil(subspaces / 2), uint8."""
    count, _, sub = books.shape
    padded = np.pad(vectors, ((0, 0), (0, count * sub - vectors.shape[1])))
    unit = padded / np.maximum(np.linalg.norm(padded, axis=1, keepdims=True), 1e-12)
    codes = np.zeros((len(vectors), count + count % 2), np.uint8)
    for m in range(count):
        at = slice(m * sub, (m + 1) * sub)
        codes[:, m] = anisotropic_codes(padded[:, at], unit[:, at], books[m], eta)
    return codes[:, ::2] << 4 | codes[:, 1::2]


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate inner products, rows x queries: for each byte of code a table of the 256 sums of its
    two subspaces for all queries, whose rows are looked up and added."""
    count, _, sub = books.shape
    padded = np.pad(queries, ((0, 0), (0, (count + count % 2) * sub - queries.shape[1])))
    books = np.concatenate([books, np.zeros((count % 2, CENTROIDS, sub))])
    tables = np.einsum("qmj,mkj->mkq", padded.reshape(len(queries), -1, sub), books).astype(np.float32)
    pairs = (tables[::2, :, None] + tables[1::2, None, :]).reshape(-1, CENTROIDS**2, len(queries))
    out = np.take(pairs[0], codes[:, 0], axis=0)
    more = np.empty_like(out)
    for b in range(1, codes.shape[1]):
        out += np.take(pairs[b], codes[:, b], axis=0, out=more)
    return out


def usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null, not zero and holds finite numbers only, of the commonest
    length (ties: the shorter)."""
    v = F.col(column)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    df = df.filter(F.coalesce(fine, F.lit(False)))
    sizes = df.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return df.filter(F.size(column) == (sizes[0]["n"] if sizes else 0))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """v and members (its ``most`` smallest ids) of each different vector. Spark drops further ids of a
    vector before the shuffle, so a vector that many rows share does not gather them."""
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))


def sampled(distinct: DataFrame, total: int) -> np.ndarray:
    """Up to SAMPLE_ROWS vectors, those of smallest hashes; about as many reach the driver."""
    bits = 30
    least = math.ceil((1 << bits) * min(1.0, 1.1 * (SAMPLE_ROWS + 100) / total))
    spot = F.shiftrightunsigned(F.xxhash64("v"), 64 - bits)
    got = distinct.select(spot.alias("spot"), "v").filter(F.col("spot") < least).toArrow()
    vectors = vectors_of(got["v"])
    order = np.lexsort((*vectors.T[::-1], got["spot"].to_numpy()))
    return vectors[order[:SAMPLE_ROWS]]


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of doubles of a column of equally long lists."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def encoded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """key and code (bytes) of each vector."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                codes = encode(vectors_of(batch.column(1)), books)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["key", "code"])

    return distinct.select("key", "v").mapInArrow(code, "key long, code binary")


def best_of_blocks(asked: DataFrame, codes: DataFrame, books: np.ndarray, total: int, queries: int, rerank: int) -> DataFrame:
    """ask, key and rough of the best candidates of each query by the scan of codes: of each block as
    many as a random share of the ``rerank`` best can hold (six deviations above the mean)."""
    shares = -(-queries // SHARE_QUERIES)
    rows = min(max(UNIT_PAIRS // min(queries, SHARE_QUERIES), BLOCK_ROWS[0]), BLOCK_ROWS[1])
    blocks = -(-total // rows)
    share = rerank / blocks
    few = rerank if blocks == 1 else min(rerank, math.ceil(share + 6 * math.sqrt(share)) + 8)

    def matched(ask: pa.Table, have: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        if len(ask) and len(have):
            keys, who, wanted = have["key"].to_numpy(), ask["ask"].to_numpy(), vectors_of(ask["v"])
            own = np.frombuffer(b"".join(have["code"].to_pylist()), np.uint8).reshape(len(have), -1)
            n = min(few, len(own))
            for at in range(0, len(wanted), CHUNK):
                rough = np.ascontiguousarray(scan(wanted[at : at + CHUNK], own, books).T)
                picks = np.argpartition(-rough, n - 1, axis=1)[:, :n]
                parts.append((np.repeat(who[at : at + CHUNK], n), keys[picks.ravel()], np.take_along_axis(rough, picks, 1).ravel()))
        ask_, key, rough = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.table({"ask": ask_, "key": key, "rough": rough})

    n = shuffle_parts(asked.sparkSession)
    left = asked.select("ask", "v", F.pmod(F.xxhash64("ask"), F.lit(shares)).cast("int").alias("share"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = codes.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    right = right.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    both = left.repartition(n, "share", "block").groupBy("share", "block").cogroup(right.repartition(n, "share", "block").groupBy("share", "block"))
    found = both.applyInArrow(matched, "ask long, key long, rough float")
    if blocks == 1:
        return found
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("rough")).alias("rough"), "key"))), 1, rerank)
    return found.groupBy("ask").agg(best.alias("best")).select("ask", F.explode("best").alias("x")).select("ask", "x.key")


RESULT = "query_id long, rank int, vec_id long, score double"


def search(df: DataFrame, is_query, *, k: int = 20, id_column: str = "vec_id", column: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """The k rows of largest inner product for each query row, its own row excepted.

    Returns query_id, rank (from 1), vec_id, score (double, exact on the original vectors); ties go
    to the smaller id. Null, zero and non-finite vectors take no part, nor do vectors of another
    length than most, nor rows with a null id. Equal vectors are scanned once and all answer: only the
    k + 1 smallest ids of such a group can be among the nearest. Repeated ids count as different rows,
    save that a query never meets its own id and that queries of one id are one query, whose score for
    a row is the largest of its vectors. An empty table, or one without queries, gives no rows. Only the
    two named columns are read, so names of others cannot clash.
    """
    spark = df.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    kind = dict(df.dtypes)[column]
    v = F.col(column) if kind in ("array<float>", "array<double>") else F.col(column).cast("array<double>")
    rows = usable(df.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")), "v").filter(F.col("vec_id").isNotNull())
    distinct = stored(distinct_vectors(rows, k + 1).withColumn("key", F.monotonically_increasing_id()), "vectors")
    asked = stored(rows.filter(is_query(F.col("vec_id"))).distinct().withColumn("ask", F.monotonically_increasing_id()), "queries")
    total, queries = distinct.count(), asked.count()
    if not (total and queries):
        return spark.createDataFrame([], RESULT)
    books = fit_codebook(sampled(distinct, total))
    codes = scratch.stored(encoded(distinct, books), "codes")
    found = stored(best_of_blocks(asked, codes, books, total, queries, rerank).select("ask", "key"), "candidates")
    scratch.drop()
    wanted = asked.select("ask", F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    pairs = found.join(distinct, "key").join(F.broadcast(wanted) if queries <= BROADCAST_QUERIES else wanted, "ask")
    exact = inner_products(pairs.select("query_id", "key", "q", "v", "members"))
    if asked.select("vec_id").distinct().count() < queries:
        exact = exact.groupBy("query_id", "key").agg(F.max("score").alias("score"), F.first("members").alias("members"))
    # Of vectors by falling score, then smallest id, the first k + 1 hold the k nearest rows.
    order = F.struct((-F.col("score")).alias("s"), F.get("members", 0).alias("first"), "members")
    near = exact.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k + 1).alias("near"))
    each = F.flatten(F.transform("near", lambda x: F.transform(x["members"], lambda m: F.struct(x["s"].alias("s"), m.alias("vec_id")))))
    others = F.array_sort(F.filter(each, lambda x: x["vec_id"] != F.col("query_id")))
    best = near.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "x"))
    return best.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def inner_products(pairs: DataFrame) -> DataFrame:
    """query_id, key, members and score, the inner product of q and v in double precision, of each pair."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                score = np.einsum("ij,ij->i", vectors_of(batch.column(2)), vectors_of(batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(score)], ["query_id", "key", "members", "score"])

    return pairs.mapInArrow(scored, "query_id long, key long, members array<long>, score double")


def op9_nearest_neighbours(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, lambda i: F.pmod(i, F.lit(20)) == 0)
