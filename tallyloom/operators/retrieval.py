"""Hybrid retrieval: BM25 and dense top-k, reciprocal rank fusion, re-ranking, review history."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import code_tokens
from tallyloom.session import Rounds, cut

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query terms (about 40 bytes each) that are broadcast at most.
BROADCAST_TERMS = 500_000


def postings(docs: DataFrame, key: str, text: str, tokens: Callable[[Column], Column] = code_tokens) -> DataFrame:
    """(key, term, tf, dl): term counts of each document with its length.

    The texts are partitioned by document before they are taken apart, so neither this count nor a
    later sum per document needs another shuffle.
    """
    t = docs.repartition(key).select(F.col(key).alias(key), tokens(F.col(text)).alias("__t"))
    t = t.select(key, F.size("__t").alias("dl"), F.explode("__t").alias("term"))
    return t.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def document_stats(docs: DataFrame, text: str, tokens: Callable[[Column], Column] = code_tokens) -> DataFrame:
    """One row: number of documents and their mean length."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens(F.col(text)))).alias("avgdl"))


def bm25(index: DataFrame, stats: DataFrame, queries: DataFrame, key: str, query_key: str, query_text: str, k: int = 10, tokens: Callable[[Column], Column] = code_tokens) -> DataFrame:
    """(query, key, score, rank): the best ``k`` documents of each query, score above 0.

    Idf by document frequency, negative ones replaced by ``EPSILON`` times the mean idf. Query
    terms count as often as they stand. Scores are rounded before ranking, ties go to the smaller
    key. The queries' terms, if at most ``BROADCAST_TERMS``, go to every partition of documents,
    where scores are summed in place; more terms meet the postings by shuffle.
    """
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(stats)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # stats: one row
    mean = raw.agg(F.avg("raw").alias("mean_idf"))  # one row
    idf = raw.join(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    q = queries.select(F.col(query_key).alias("query"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qf"))
    need = q.join(idf, "term")
    if q.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        need = F.broadcast(need)
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("qf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    scored = index.join(need, "term").groupBy("query", key).agg(F.round(F.sum(part), 6).alias("score"))
    w = W.partitionBy("query").orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("score") > 0))


#: Cells (documents x queries) that a task scores at once, and about as many uses of terms; some 50 bytes each in all.
SCORE_CELLS = 1_000_000


def _first(k: int, sign: int, q: np.ndarray, value: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``k`` rows of least ``sign`` * value, then key, in this order."""
    order = np.lexsort((key, sign * value, q))
    q, value, key = q[order], value[order], key[order]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    top = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)])) < k
    return q[top], value[top], key[top]


def _best(terms: list[str], first: np.ndarray, query_of: np.ndarray, weight: np.ndarray, n_queries: int, avgdl: float, k: int):
    """The ``k`` best documents of each query among those of one partition, from rows (key, tokens).

    ``first[t]`` .. ``first[t + 1]`` are the uses (query, weight) of term t.
    """
    uses = np.diff(first)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(terms, pa.string())
        step = max(1, SCORE_CELLS // n_queries)
        held: tuple | None = None
        least = np.zeros(n_queries)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                lists = b.column(1)
                dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                known = pc.fill_null(pc.index_in(lists.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(dl)), dl)
                code, tf = np.unique((doc * len(terms) + known)[known >= 0], return_counts=True)
                if not len(code):
                    continue
                doc, term = code // len(terms), code % len(terms)
                part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
                n = uses[term]
                ends = np.cumsum(n)
                score = np.zeros(len(dl) * n_queries)
                lo = 0
                while lo < len(n):  # so many postings that their uses are about as many as the cells
                    hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SCORE_CELLS, side="right")))
                    m = n[lo:hi]
                    use = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m - first[term[lo:hi]], m)
                    cell = np.repeat(doc[lo:hi] - doc[lo], m) * n_queries + query_of[use]
                    add = np.bincount(cell, weights=np.repeat(part[lo:hi], m) * weight[use])
                    score[doc[lo] * n_queries : doc[lo] * n_queries + len(add)] += add
                    lo = hi
                score = np.round(score.reshape(len(dl), n_queries), 6)
                if len(dl) > k:
                    least = np.maximum(least, np.partition(score, len(dl) - k, axis=0)[len(dl) - k])
                d, q = np.nonzero((score >= least) & (score > 0))
                key = b.column(0).to_numpy(zero_copy_only=False)
                key = (key.astype(str) if key.dtype == object else key)[d]
                new = (q, score[d, q], key)
                held = _first(k, -1, *(new if held is None else (np.concatenate(x) for x in zip(held, new))))
                full = np.bincount(held[0], minlength=n_queries) >= k
                last = np.zeros(n_queries)
                last[held[0]] = held[1]  # rows are sorted: the last of a query is its least
                least = np.where(full, np.maximum(least, last), least)
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), pa.array(held[2]), pa.array(held[1])], names=["no", "key", "score"])

    return kernel


def search_texts(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k: int = 10, tokens: Callable[[Column], Column] = code_tokens) -> DataFrame:
    """``bm25`` over texts without a stored index: (query, key, score, rank), the best ``k`` documents of each query.

    Document frequencies come from one partially combined count of terms; then each task scores its
    own documents against a block of queries and keeps the best ``k`` of each, so no postings and no
    scores of pairs are shuffled. A block holds so many queries that their terms are at most
    ``BROADCAST_TERMS``. Null texts match nothing.
    """
    spark = docs.sparkSession
    kept = Rounds(spark)
    rows = kept.cut(docs.filter(F.col(text).isNotNull()).select(F.col(key).alias(key), tokens(F.col(text)).alias("__t")))  # taken apart once
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.size("__t")).alias("avgdl")).first()
    named = T.StructType([T.StructField("query", queries.schema[query_key].dataType), T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    q = queries.select(F.col(query_key).alias("query"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qf"))
    df = rows.select(F.explode(F.array_distinct("__t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = cut(df.select("term", (F.log(F.lit(stats.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    mean = raw.agg(F.avg("raw").alias("m")).first().m or 0.0
    need = cut(q.join(raw, "term").select("query", "term", (F.col("qf") * F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw"))).alias("weight")))
    blocks = -(-need.count() // BROADCAST_TERMS)
    out: DataFrame | None = None
    for n in range(blocks):
        part = need if blocks == 1 else need.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n)
        mine = part.toPandas().sort_values(["term", "query"], kind="stable")  # one block of queries
        if mine.empty:
            continue
        names, number = np.unique(mine["query"].to_numpy(), return_inverse=True)
        words, counts = np.unique(mine["term"].to_numpy().astype(str), return_counts=True)
        mine = mine.assign(no=number).sort_values(["term", "no"], kind="stable", key=lambda c: c.astype(str) if c.name == "term" else c)
        first = np.r_[0, np.cumsum(counts)]
        schema = T.StructType([T.StructField("no", T.IntegerType()), T.StructField("key", named[key].dataType), T.StructField("score", T.DoubleType())])
        top = rows.mapInArrow(_best(words.tolist(), first, mine["no"].to_numpy(), mine["weight"].to_numpy(), len(names), stats.avgdl or 1.0, k), schema)
        of = spark.createDataFrame([(i, x.item() if hasattr(x, "item") else x) for i, x in enumerate(names)], T.StructType([T.StructField("no", T.IntegerType()), named["query"]]))
        found = top.join(F.broadcast(of), "no").select("query", F.col("key").alias(key), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], named)
    w = W.partitionBy("query").orderBy(F.desc("score"), F.asc(key))
    return kept.done(out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


#: Queries that go to every row at once; more are taken in blocks of this size.
QUERY_BLOCK = 4096


def _nearest(asked: np.ndarray, k: int):
    """The ``k`` vectors of one partition that are nearest to each row of ``asked``, from rows (key, vector).

    A matrix product tells which can be among them, with room for its rounding; only for these the
    distance is computed, from the differences.
    """
    norms = (asked * asked).sum(axis=1)
    n_queries, dim = asked.shape

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORE_CELLS // n_queries)
        held: tuple | None = None
        most = np.full(n_queries, np.inf)
        for whole in batches:
            right = pc.equal(pc.list_value_length(whole.column(1)), dim)
            usable = whole.filter(pc.fill_null(right, False))
            for at in range(0, usable.num_rows, step):
                b = usable.slice(at, step)
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                size = (v * v).sum(axis=1)
                square = size[:, None] + norms[None, :] - 2.0 * (v @ asked.T)
                room = 1e-9 * (size.max() + norms.max() + 1.0)
                limit = most * most
                if len(v) > k:
                    limit = np.minimum(limit, np.partition(square, k - 1, axis=0)[k - 1])
                d, q = np.nonzero(square <= limit + 2e-6 * (np.sqrt(np.maximum(limit, 0.0)) + 1.0) + room)
                key = b.column(0).to_numpy(zero_copy_only=False)
                key = (key.astype(str) if key.dtype == object else key)[d]
                diff = v[d] - asked[q]
                new = (q, np.round(np.sqrt((diff * diff).sum(axis=1)), 6), key)
                held = _first(k, 1, *(new if held is None else (np.concatenate(x) for x in zip(held, new))))
                last = np.full(n_queries, np.inf)
                last[held[0]] = held[1]  # rows are sorted: the last of a query is its farthest
                most = np.where(np.bincount(held[0], minlength=n_queries) >= k, np.minimum(most, last), np.inf)
        if held is not None and len(held[0]):
            ok = np.isfinite(held[1])
            yield pa.RecordBatch.from_arrays([pa.array(held[0][ok], pa.int32()), pa.array(held[2][ok]), pa.array(held[1][ok])], names=["no", "key", "distance"])

    return kernel


def dense_top(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, query_vector: str, k: int = 10) -> DataFrame:
    """(query, key, distance, rank): the ``k`` nearest vectors of each query by L2 distance, exactly.

    The queries are a stated set; blocks of ``QUERY_BLOCK`` of them go to every task, which keeps the
    best ``k`` of each among its own vectors, so no pairs are shuffled. Distances are rounded before
    ranking, ties go to the smaller key. Null vectors, and those of another length than the query's, match nothing.
    """
    spark = vectors.sparkSession
    q = queries.select(F.col(query_key).alias("query"), F.col(query_vector).alias("__q")).dropna().withColumn("__n", F.size("__q"))
    lengths = q.groupBy("__n").count().collect()  # one row per length of vectors
    named = {"query": queries.schema[query_key].dataType, "key": vectors.schema[key].dataType}
    schema = T.StructType([T.StructField("no", T.IntegerType()), T.StructField("key", named["key"]), T.StructField("distance", T.DoubleType())])
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("__v"))
    out: DataFrame | None = None
    for length in lengths:
        blocks = -(-length["count"] // QUERY_BLOCK)
        for n in range(blocks):
            part = q.filter(F.col("__n") == length["__n"])
            mine = (part if blocks == 1 else part.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n)).select("query", "__q").collect()  # one block of queries
            if not mine or not length["__n"]:
                continue
            asked = np.array([r["__q"] for r in mine], dtype=np.float64)
            of = spark.createDataFrame([(i, r["query"]) for i, r in enumerate(mine)], T.StructType([T.StructField("no", T.IntegerType()), T.StructField("query", named["query"])]))
            found = rows.mapInArrow(_nearest(asked, k), schema).join(F.broadcast(of), "no").select("query", F.col("key").alias(key), "distance")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField("query", named["query"]), T.StructField(key, named["key"]), T.StructField("distance", T.DoubleType())]))
    w = W.partitionBy("query").orderBy(F.asc("distance"), F.asc(key))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(lists: dict[str, DataFrame], keys: list[str], rrf_k: int = 60, final_k: int = 5) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query, keys, rank): sum of 1 / (rrf_k + rank) per key, best ``final_k`` per query.

    A rank per list comes along, 0 where the list lacks the key. Ties go to the first list, then
    to the better ranks.
    """
    names = list(lists)
    rows: DataFrame | None = None
    for n, df in lists.items():
        part = df.select("query", *keys, F.lit(n).alias("list"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    ranks = [F.coalesce(F.max(F.when(F.col("list") == n, F.col("rank"))), F.lit(0)).alias(f"{n}_rank") for n in names]
    f = rows.groupBy("query", *keys).agg(F.round(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))), 9).alias("score"), *ranks)
    order = [F.desc("score"), *[x for n in names for x in ((F.col(f"{n}_rank") == 0).asc(), F.asc(f"{n}_rank"))], *[F.asc(k) for k in keys]]
    w = W.partitionBy("query").orderBy(*order)
    return f.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= final_k)


def rerank(hits: DataFrame, scores: DataFrame, keys: list[str], top_k: int) -> DataFrame:
    """Hits by the scores of a second model; those it left out follow in their old order (``place``)."""
    s = scores.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("score").alias("__s"))
    cond = hits[keys[0]].eqNullSafe(s[f"__{keys[0]}"])
    for k in keys[1:]:
        cond = cond & hits[k].eqNullSafe(s[f"__{k}"])
    j = hits.join(s, cond, "left")
    w = W.partitionBy("query").orderBy(F.col("__s").isNull(), F.desc("__s"), F.asc("place"))
    return j.withColumn("new_place", F.row_number().over(w)).filter(F.col("new_place") <= top_k).select(*hits.columns, "new_place")


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], query: str = "query_text", text: str = "text") -> DataFrame:
    """Pairs with the score of an injected model, in Arrow batches; the model is any function of two series."""
    udf = F.pandas_udf(scorer, "double")
    return pairs.withColumn("score", udf(F.col(query), F.col(text)))


def context_text(hits: DataFrame, keys: list[str], path: str = "file_path", text: str = "content", place: str = "place") -> DataFrame:
    """Hits of each query as one context text, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.concat(F.lit("### "), F.col(path), F.lit("\n"), F.col(text)).alias("t"))))
    return hits.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("context"))


def keep_history(old: DataFrame, new: DataFrame, limit: int = 500) -> DataFrame:
    """History entries (pr_number, repo, ord, ...) after adding ``new``: one per (pr_number, repo), the newest ``limit`` of all.

    The newest entry per key wins by aggregation; the limit over everything is a top-n, not a
    window over one partition.
    """
    rows = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in ("pr_number", "repo", "ord")]
    latest = rows.groupBy("pr_number", "repo").agg(F.max(F.struct("ord", *rest)).alias("r")).select("pr_number", "repo", "r.*")
    return latest.orderBy(F.desc("ord")).limit(limit)


def similar_history(hits: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """History entries of ranked hits (query, pr_number, repo, rank), the first match of each, at most ``k`` per query."""
    j = hits.join(history, ["pr_number", "repo"])
    w = W.partitionBy("query").orderBy("rank", "pr_number", "repo")
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def save_index(path: str, index: DataFrame, stats: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None) -> None:
    """Write an index as Parquet tables below ``path``: postings (sorted by term within files, so a term's lookup skips row groups), statistics, chunks, vectors."""
    index.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an index; one without vectors is as good (its search is lexical only)."""
    out = {n: spark.read.parquet(f"{path}/{n}") for n in ("postings", "stats", "chunks")}
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/vectors")
    if of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(of):
        out["vectors"] = spark.read.parquet(f"{path}/vectors")
    return out


def embed(df: DataFrame, text: str, model: Callable[[pd.Series], pd.Series], normalise: bool = True) -> DataFrame:
    """``df`` with ``embedding``: an injected model over Arrow batches of texts (null as empty), of unit length unless told otherwise."""
    udf = F.pandas_udf(model, "array<float>")
    raw = df.withColumn("__e", udf(F.coalesce(F.col(text), F.lit(""))))
    if not normalise:
        return raw.withColumnRenamed("__e", "embedding")
    norm = F.sqrt(F.aggregate("__e", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.when(norm > 0, F.transform("__e", lambda x: (x / norm).cast("float"))).otherwise(F.col("__e"))
    return raw.withColumn("embedding", unit).drop("__e")
