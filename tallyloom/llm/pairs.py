"""Defective question-answer pairs, from stages and from comment threads.

A pair is one row, so flagging is a map without shuffle; only the comment pairs need an order. It
comes from a distributed sort of ids and times alone; the two bodies join by id afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.conversations import latest_comments, timed
from tallyloom.llm.textcheck import defect
from tallyloom.operators.ranking import distributed_rank
from tallyloom.session import cut
from tallyloom.tables import latest_by_id

_SCHEMA = "pair_source string, pair_id long, defect string"


def _kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        source, ids, questions, answers = (b.column(k).to_pylist() for k in range(4))
        found = [(s, i, d) for s, i, q, a in zip(source, ids, questions, answers) if (d := defect(q, a))]
        if found:
            s, i, d = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(i, pa.int64()), pa.array(d)], names=["pair_source", "pair_id", "defect"])


def stage_pairs(stages: DataFrame) -> DataFrame:
    """(pair_source, pair_id, question, answer) of the stage results: prompt and raw output, one row per id."""
    s = latest_by_id(stages.select(F.col("id").cast("long"), "prompt", "raw_output", "created_at").filter("id is not null"), "id", "created_at")
    return s.select(F.lit("stage").alias("pair_source"), F.col("id").alias("pair_id"), F.col("prompt").alias("question"), F.col("raw_output").alias("answer"))


def comment_pairs(comments: DataFrame) -> DataFrame:
    """(pair_source, pair_id, question, answer) of the bot comments whose direct predecessor in their thread is a user's."""
    c = latest_comments(comments).filter(F.col("thread_id").isNotNull() & timed(F.col("created_at")))
    order = distributed_rank(c.select("thread_id", "id", "role", "created_at"), ["thread_id"], ["created_at", "id"], "place")
    order = cut(order.select("thread_id", "place", "id", "role"))
    bots = order.filter("role = 'assistant'")
    users = order.filter("role = 'user'").select(F.col("thread_id").alias("th"), (F.col("place") + 1).alias("next"), F.col("id").alias("asked"))
    links = bots.join(users, (F.col("thread_id") == F.col("th")) & (F.col("place") == F.col("next"))).select(F.col("id").alias("pair_id"), "asked")
    bodies = latest_by_id(comments.select("id", "edited_at", "body").filter("id is not null"), "id", "edited_at")
    answers = links.join(bodies.select(F.col("id").alias("ia"), F.col("body").alias("answer")), F.col("pair_id") == F.col("ia"))
    both = answers.join(bodies.select(F.col("id").alias("iq"), F.col("body").alias("question")), F.col("asked") == F.col("iq"))
    return both.select(F.lit("comment").alias("pair_source"), "pair_id", "question", "answer")


def flag_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_source, pair_id, defect) of the defective rows of (pair_source, pair_id, question, answer).

    The first defect that applies of empty, copy, refusal, truncated and wrong_language. A null
    answer is empty; a null or blank question can't be copied and asks for no language. Texts of
    any length are read whole.
    """
    p = pairs.select("pair_source", F.col("pair_id").cast("long"), "question", "answer")
    return p.mapInArrow(_kernel, _SCHEMA)


def defective_pairs(stages: DataFrame, comments: DataFrame) -> DataFrame:
    """Defective pairs of the stages and of the comments, each pair once. Empty tables give no rows."""
    return flag_pairs(stage_pairs(stages).unionByName(comment_pairs(comments)))
