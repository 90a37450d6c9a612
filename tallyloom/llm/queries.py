"""Queries of the training-data problems, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.functions.text import norm_name
from tallyloom.llm.conversations import conversations, latest_comments, ordered_turns
from tallyloom.llm.docpairs import documented_functions
from tallyloom.llm.leakage import leaked
from tallyloom.llm.near_duplicates import near_duplicates
from tallyloom.llm.packing import TOKENIZER, pack_documents
from tallyloom.llm.pairs import defective_pairs
from tallyloom.llm.quantiles import combine, daily_counts, percentiles
from tallyloom.llm.splitting import split_oversized
from tallyloom.operators.graph import components
from tallyloom.plans.registry import Registry
from tallyloom.session import cut
from tallyloom.tables import latest_by_id, load

R = Registry()

_TURNS = r"""
    WITH v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY edited_at DESC NULLS LAST, thread_id, author, body) AS k FROM comments WHERE id IS NOT NULL),
    c AS (SELECT id, thread_id, author, created_at, coalesce(is_bot, false) OR coalesce(lower(regexp_replace(author, '[\s\p{Z}]+$', '')) LIKE '%[bot]', false) AS bot,
                 length(regexp_replace(coalesce(body, ''), '[\p{Z}\p{C}\s]', '', 'g')) > 0 AS is_turn,
                 author IS NOT NULL AND length(regexp_replace(author, '[\p{Z}\p{C}\s]', '', 'g')) > 0 AND created_at IS NOT NULL AND year(created_at) >= 2000 AS sound
          FROM v WHERE k = 1 AND thread_id IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at, id) AS turn, row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, id DESC) AS back FROM c WHERE is_turn),
    g AS (SELECT thread_id FROM c GROUP BY 1 HAVING bool_and(sound)),
    h AS (SELECT thread_id FROM t GROUP BY 1 HAVING count(*) FILTER (WHERE NOT bot) > 0 AND bool_or(bot AND back = 1))
    SELECT thread_id, CAST(turn AS INTEGER) AS turn, id AS comment_id, CASE WHEN bot THEN 'assistant' ELSE 'user' END AS role
    FROM t WHERE thread_id IN (SELECT thread_id FROM g) AND thread_id IN (SELECT thread_id FROM h) AND thread_id IN (SELECT id FROM comment_threads)
    """


@R.add("p1_found", _TURNS)
def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Turns of every whole conversation of the comments."""
    return conversations(load(spark, directory, "comments"), load(spark, directory, "comment_threads"))


#: Threads in which the first turn and a later last one have the same sender: their links are made contradictory.
_CONTRADICTORY = """thread_id IN (SELECT thread_id FROM (SELECT thread_id, arg_min(lower(trim(author)), (created_at, id)) AS a, arg_max(lower(trim(author)), (created_at, id)) AS z, min(created_at) AS f, max(created_at) AS l FROM t GROUP BY 1) WHERE a = z AND l > f)"""


@R.add("p1_skewed", _TURNS.rstrip() + f" AND NOT {_CONTRADICTORY}")
def p1_skewed(spark: SparkSession, directory: str) -> DataFrame:
    """The conversations from skewed clocks: each sender's clock is put wrong by up to 20 minutes, and reply links bring the true order back.

    The links are those of each turn to the one before it. Threads whose last turn is by the sender
    of the first get a link from the last to the first as well: no clocks can meet it, so they are
    rejected.
    """
    comments, threads = load(spark, directory, "comments"), load(spark, directory, "comment_threads")
    return conversations(skewed(comments), threads, chained(comments, ordered_turns(comments, threads)[0]))


@R.add("p6_containers")
def p6_containers(spark: SparkSession, directory: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every non-blank document in a container of 2,048 tokens."""
    return pack_documents(load(spark, directory, "documents"), 2048, tokenizer)


@R.add("p7_found")
def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that repeat a passage of an evaluation item, with the item."""
    return leaked(load(spark, directory, "documents"), load(spark, directory, "eval_items")).select("doc_id", "item_id")


def skewed(comments: DataFrame) -> DataFrame:
    """The comments as clocks show them that are wrong by -20 to 20 minutes, the same for all comments of an author."""
    minutes = (F.length(F.lower(F.trim("author"))) % 5 - 2) * 10
    return comments.withColumn("created_at", F.coalesce(F.col("created_at") + F.make_dt_interval(mins=minutes), "created_at"))


def chained(comments: DataFrame, turns: DataFrame) -> DataFrame:
    """(earlier_id, later_id): each turn after the one before it, and the planted contradictions."""
    t = cut(turns)
    before = t.select(F.col("thread_id").alias("th"), (F.col("turn") + 1).alias("next"), F.col("id").alias("earlier_id"))
    links = t.join(before, (F.col("thread_id") == F.col("th")) & (F.col("turn") == F.col("next"))).select("earlier_id", F.col("id").alias("later_id"))
    who = latest_comments(comments).select(F.col("id").alias("comment_id"), F.lower(F.trim("author")).alias("sender"), "created_at")
    ends = t.join(who, F.col("id") == F.col("comment_id")).groupBy("thread_id").agg(*[f(F.struct("comment_id", "sender", "created_at"), "turn").alias(k) for k, f in (("a", F.min_by), ("z", F.max_by))])
    wrong = ends.filter("a.sender = z.sender and z.created_at > a.created_at").select(F.col("z.comment_id").alias("earlier_id"), F.col("a.comment_id").alias("later_id"))
    return cut(links.unionByName(wrong))


@R.add(
    "p8_found",
    r"""
    SELECT DISTINCT doc_id FROM documents
    WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]+')) > 512
    """,
)
def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents of more than 512 tokens: those that the splitter cuts into pieces."""
    return split_oversized(load(spark, directory, "documents")).filter("piece = 1").select("doc_id").distinct()


@R.add("p8_pieces")
def p8_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of every document of more than 512 tokens, in order, with their overlap."""
    return split_oversized(load(spark, directory, "documents"))


@R.add("p8_bpe_pieces")
def p8_bpe_pieces(spark: SparkSession, directory: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The like with the tokens of the public byte-level vocabulary."""
    return split_oversized(load(spark, directory, "documents"), tokenizer=tokenizer)


@R.add(
    "p8_rejoined",
    r"""
    SELECT DISTINCT doc_id, md5(text) AS text_md5, true AS in_order, true AS within_limit, true AS overlaps FROM documents
    WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}]+')) > 512
    """,
)
def p8_rejoined(spark: SparkSession, directory: str) -> DataFrame:
    """Each text put together again from its pieces: its checksum, and whether order, limit and overlap hold."""
    p = split_oversized(load(spark, directory, "documents").select("doc_id", "text").distinct())
    before = F.lag("end_char").over(W.partitionBy("doc_id").orderBy("piece"))  # the pieces of one document
    p = p.withColumn("before", F.coalesce(before, F.lit(0)))
    new = F.substring(F.col("text"), F.col("before") - F.col("start_char") + 1, F.length("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", new.alias("new")))), lambda x: x["new"]), "")
    ok = [F.bool_and((F.col("start_char") <= F.col("before")) & (F.col("before") < F.col("end_char"))), F.bool_and(F.col("n_tokens") <= 512), F.bool_and((F.col("piece") == 1) | F.col("n_repeated").between(48, 64))]
    return p.groupBy("doc_id").agg(F.md5(whole).alias("text_md5"), *[c.alias(n) for c, n in zip(ok, ("in_order", "within_limit", "overlaps"))])


@R.add("p3_found")
def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Functions whose own documentation, directly above or inside, says something."""
    return documented_functions(load(spark, directory, "source_files")).filter("depth = 0").select("file_id", "qualified_name")


@R.add("p3_pairs")
def p3_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Code-description pairs: signature and documentation, own or inherited."""
    return documented_functions(load(spark, directory, "source_files"))


@R.add("p2_found")
def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Defective pairs of stage results and of bot replies, with the defect."""
    return defective_pairs(load(spark, directory, "stage_results"), load(spark, directory, "comments"))


#: The path rule of ``functions.text.norm_path`` in SQL.
_PATH = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(file_path), '\', '/'), '^\s+|\s+$', '', 'g'), '/(\./)+', '/', 'g'), '/{2,}', '/', 'g'), '^(\./|/)+', '')"""
_WORDS = r"list_distinct(regexp_extract_all(lower(message), '[\p{L}\p{N}_]+'))"


def review_day_counts(spark: SparkSession, directory: str, relative_error: float = 0.0) -> DataFrame:
    """Per-day intermediates of the review percentiles: (day, grp, metric, value, n).

    Reviews that never ran (no completion, duration and cost still at their default 0) measure
    nothing; their duration is left out, as are null, NaN, infinite and negative values.
    """
    r = latest_by_id(load(spark, directory, "reviews").select("id", "model_used", "duration_seconds", "cost_estimate", "created_at", "completed_at"), "id")
    ran = F.col("completed_at").isNotNull()
    return daily_counts(r, norm_name(F.col("model_used")), F.to_date("created_at"), {"duration_seconds": F.when(ran, F.col("duration_seconds")), "cost_estimate": F.when(ran, F.col("cost_estimate"))}, relative_error)


@R.add(
    "p4_percentiles",
    """
    WITH r AS (SELECT DISTINCT * FROM reviews WHERE completed_at IS NOT NULL),
    v AS (
      SELECT nullif(regexp_replace(lower(trim(model_used)), '[_ ]+', '-', 'g'), '') AS model_used, unnest(['duration_seconds', 'cost_estimate']) AS metric, unnest([duration_seconds, cost_estimate]) AS value FROM r
    ), ok AS (SELECT * FROM v WHERE value IS NOT NULL AND NOT isnan(value) AND value >= 0 AND NOT isinf(value))
    SELECT model_used, metric, count(*) AS n, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.9), 9) AS p90,
           round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99, CAST(0 AS DOUBLE) AS error_bound
    FROM ok GROUP BY ALL
    """,
)
def p4_percentiles(spark: SparkSession, directory: str) -> DataFrame:
    """p50, p90, p95 and p99 of duration and cost per model, exact (error bound 0), from combined per-day counts."""
    p = percentiles(combine(review_day_counts(spark, directory)))
    rounded = [F.round(c, 9).alias(c) for c in ("p50", "p90", "p95", "p99")]
    return p.select(F.col("grp").alias("model_used"), "metric", "n", *rounded, F.lit(0.0).alias("error_bound"))


@R.add(
    "p4_day_counts",
    """
    WITH r AS (SELECT DISTINCT * FROM reviews WHERE completed_at IS NOT NULL),
    v AS (
      SELECT CAST(created_at AS DATE) AS day, nullif(regexp_replace(lower(trim(model_used)), '[_ ]+', '-', 'g'), '') AS model_used, unnest(['duration_seconds', 'cost_estimate']) AS metric, unnest([duration_seconds, cost_estimate]) AS value FROM r
    ) SELECT day, model_used, metric, value, count(*) AS n FROM v WHERE value IS NOT NULL AND NOT isnan(value) AND value >= 0 AND NOT isinf(value) GROUP BY ALL
    """,
)
def p4_day_counts(spark: SparkSession, directory: str) -> DataFrame:
    """The per-day intermediates: counts of values per day and model, which add up over any set of days."""
    return review_day_counts(spark, directory).withColumnRenamed("grp", "model_used")


_ALIKE = f"""
    WITH f AS (SELECT DISTINCT id, {_PATH} AS path, line_start AS line, {_WORDS} AS w FROM findings WHERE file_path IS NOT NULL AND message IS NOT NULL AND line_start IS NOT NULL),
    ok AS (SELECT * FROM f WHERE path <> '' AND len(w) > 0)
    SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM ok a JOIN ok b ON a.path = b.path AND a.id < b.id AND abs(a.line - b.line) <= 3
    WHERE len(list_intersect(a.w, b.w)) >= 0.6 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9
    """


@R.add("p5_found", _ALIKE)
def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of findings of one place whose messages share 60 % of their words."""
    return near_duplicates(load(spark, directory, "findings"), "id", "file_path", "line_start", "message", threshold=0.6, max_gap=3)


@R.add(
    "p5_groups",
    f"""
    WITH RECURSIVE pairs AS ({_ALIKE}), e AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT a AS id, least(a, min(b)) AS component FROM r GROUP BY a
    """,
)
def p5_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Findings that report the same at the same place, with their group (its least id), one row per grouped finding."""
    return components(near_duplicates(load(spark, directory, "findings"), "id", "file_path", "line_start", "message", threshold=0.6, max_gap=3, every=False))
