"""Conversations put together again from message rows.

Steps: the latest version of each message; roles; per-thread checks by plain aggregation; reply-
before constraints; sender clock offsets from them by least squares; corrected times; turns merged
in time order by a distributed sort (a thread that holds a third of all rows is no one task's);
threads whose constraints no offsets can meet are rejected.

Constraints. A message that quotes another one of its thread (lines after ``>``) was written after
it, whatever the clocks say; known reply links may be given instead. A constraint says that message
j answers message i, so in true time it comes ``min_gap`` later. With a clock offset o per sender it
asks for

    (t_j + o_j) - (t_i + o_i) >= min_gap.

The offsets minimise the sum of squared violations (plus ``ridge`` times the sum of squared
offsets), from zero on, by damped Jacobi steps with momentum on the normal equations of the violated
constraints; every step is one join with the offsets and one partially aggregated sum. The offsets are broadcast behind a
count; beyond it the join is by shuffle, with the sender salted, as a bot may be on each constraint.
A thread with a constraint that is still violated by more than ``tolerance`` is infeasible.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import blank
from tallyloom.operators.ranking import distributed_rank
from tallyloom.session import Rounds, cut
from tallyloom.tables import latest_by_id

#: Earlier times are no times of a comment (unset clocks).
FIRST_YEAR = 2000
#: Senders up to this number are broadcast with their offsets (some 40 bytes each); beyond it senders are salted.
BROADCAST_SENDERS = 200_000
#: Parts into which a sender's constraints are dealt beyond that.
SALTS = 32
#: Quoted lines up to this number are broadcast (24 bytes each).
BROADCAST_LINES = 500_000


def role_of(author: Column, is_bot: Column) -> Column:
    """``assistant`` where is_bot is true or the trimmed author ends in ``[bot]`` in any case, else ``user``."""
    bot = F.coalesce(is_bot, F.lit(False)) | F.coalesce(F.lower(F.regexp_replace(author, r"[\s\p{Z}]+$", "")).endswith("[bot]"), F.lit(False))
    return F.when(bot, F.lit("assistant")).otherwise(F.lit("user"))


def timed(col: Column) -> Column:
    """Whether a time is usable: not null and of the year 2000 or later."""
    return col.isNotNull() & (F.year(col) >= FIRST_YEAR)


def _lines(body: Column) -> Column:
    """Hashes of the lines of a text, each behind whether it is quoted; blank lines don't count."""
    lines = F.filter(F.transform(F.split(body, r"\r\n|\n|\r"), lambda x: F.struct(x.rlike(r"^\s*>").alias("quoted"), F.regexp_replace(F.lower(F.regexp_replace(x, r"^(\s*>)+", "")), r"\s+", " ").alias("line"))), lambda x: F.length(F.trim(x["line"])) > 0)
    return F.transform(lines, lambda x: F.struct(x["quoted"].alias("quoted"), F.xxhash64(F.trim(x["line"])).alias("line")))


def latest_comments(comments: DataFrame, lines: bool = False) -> DataFrame:
    """(id, thread_id, author, no_body, created_at, role): the latest version of each comment; rows without an id are dropped.

    Of the body only whether it is blank comes along and, with ``lines``, the hashes of its lines, so no text is shuffled.
    """
    c = comments.select("id", "thread_id", "author", blank(F.col("body")).alias("no_body"), "is_bot", "created_at", "edited_at", *([_lines(F.col("body")).alias("lines")] if lines else [])).filter("id is not null")
    return latest_by_id(c, "id", "edited_at").withColumn("role", role_of(F.col("author"), F.col("is_bot")))


def _offset_of(constraints: DataFrame, offsets: DataFrame, end: str, n: int) -> DataFrame:
    """``constraints`` with ``o<end>``, the offset of the sender ``s<end>`` (0 where none is known), of ``n`` offsets."""
    if n <= BROADCAST_SENDERS:
        named = F.broadcast(offsets.select(F.col("sender").alias("__s"), F.col("offset").alias("__o")))
        both = constraints.join(named, F.col(f"s{end}") == F.col("__s"), "left")
    else:
        named = offsets.select(F.col("sender").alias("__s"), F.col("offset").alias("__o"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__k"))
        both = constraints.join(named, (F.col(f"s{end}") == F.col("__s")) & (F.pmod(F.xxhash64("thread", "gap"), F.lit(SALTS)) == F.col("__k")), "left").drop("__k")
    return both.withColumn(f"o{end}", F.coalesce("__o", F.lit(0.0))).drop("__s", "__o")


def _violated(constraints: DataFrame, offsets: DataFrame | None, min_gap: float, n: int = 0) -> DataFrame:
    """Constraints (thread, si, sj, gap) with ``short``: by how many seconds each is missed, where it is."""
    if offsets is None:
        return constraints.withColumn("short", F.lit(min_gap) - F.col("gap")).filter("short > 0")
    both = _offset_of(_offset_of(constraints, offsets, "i", n), offsets, "j", n)
    return both.withColumn("short", F.lit(min_gap) - F.col("gap") - F.col("oj") + F.col("oi")).drop("oi", "oj").filter("short > 0")


def clock_offsets(constraints: DataFrame, min_gap: float = 0.0, ridge: float = 0.0, tolerance: float = 0.5, rounds: int = 500) -> DataFrame | None:
    """(sender, offset seconds) by least squares from constraints (thread, si, sj, gap), or None where all offsets are zero.

    ``gap`` is t_j - t_i in seconds as the clocks show it. Constraints within one sender say
    nothing on offsets. The fit aims half a ``tolerance`` beyond ``min_gap``, so that it ends where
    all constraints are met to half the tolerance; where some can't be met it ends when no step
    moves an offset by a hundredth of it. Steps carry momentum; whenever they grow it is dropped and the next are shorter.
    A system that still moves after ``rounds`` steps raises: no unsettled offsets are returned.
    """
    across = constraints.filter("si is not null and sj is not null and si <> sj").select("thread", "si", "sj", "gap")
    if not _violated(across, None, min_gap).limit(1).count():
        return None  # the least-squares solution of least norm
    across = cut(across)
    state: DataFrame | None = None  # sender, offset, last: the offset one step before
    calm, moved_before, damping, n = 0, math.inf, 0.5, 0
    kept = Rounds(constraints.sparkSession)
    for _ in range(rounds):
        ahead = F.lit(calm / (calm + 3))
        at = None if state is None else state.select("sender", (F.col("offset") + ahead * (F.col("offset") - F.col("last"))).alias("offset"), F.col("offset").alias("last"))
        v = _violated(across, at, min_gap + tolerance / 2, n)
        pulls = v.select(F.explode(F.array(F.struct(F.col("sj").alias("sender"), F.col("short").alias("pull")), F.struct(F.col("si").alias("sender"), (-F.col("short")).alias("pull")))).alias("e")).select("e.*")
        steps = pulls.groupBy("sender").agg(F.sum("pull").alias("pull"), F.count("*").alias("deg"), F.max("pull").alias("short"))
        if at is None:
            joined = steps.withColumns({"o": F.lit(0.0), "last": F.lit(0.0)})
        else:
            joined = at.select(F.col("sender").alias("s0"), F.col("offset").alias("o"), F.col("last").alias("l")).join(steps, F.col("s0") == F.col("sender"), "full")
            joined = joined.select(F.coalesce("s0", "sender").alias("sender"), F.coalesce("o", F.lit(0.0)).alias("o"), F.coalesce("l", F.lit(0.0)).alias("last"), "pull", "deg", "short")
        step = F.when(F.col("deg").isNull(), F.lit(0.0)).otherwise(F.lit(damping) * (F.col("pull") - F.lit(ridge) * F.col("o")) / F.greatest(F.col("deg") + F.lit(ridge), F.lit(1.0)))
        state = kept.cut(joined.select("sender", (F.col("o") + step).alias("offset"), "last", F.coalesce("short", F.lit(0.0)).alias("short"), F.abs(F.col("o") + step - F.col("last")).alias("moved")))
        r = state.agg(F.count("*").alias("n"), F.max("short").alias("short"), F.max("moved").alias("most"), F.sum(F.col("moved") * F.col("moved")).alias("moved")).first()
        n = r.n
        if at is not None and r.short <= tolerance:
            return kept.done(at.select("sender", "offset"))
        if r.most <= tolerance / 100:
            return kept.done(state.select("sender", "offset"))
        if r.moved <= moved_before:
            calm += 1
        else:  # overshot, or constraints that take turns in being violated: shorter steps
            calm, damping = 0, 0.7 * damping
        moved_before = r.moved
    kept.done()
    raise RuntimeError(f"clock offsets still move after {rounds} rounds")


def quote_links(turns: DataFrame) -> DataFrame:
    """(earlier_id, later_id) of turns (thread_id, id, t, lines): a turn that quotes a line comes after the first one that says it.

    The lines quoted are counted; up to ``BROADCAST_LINES`` they are broadcast, so that of all
    other lines only those are shuffled that someone quotes. Each quoted line has one source, so
    lines that many turns repeat make no pairs among themselves.
    """
    lines = turns.select("thread_id", "id", "t", F.explode("lines").alias("l")).select("thread_id", "id", "t", "l.quoted", "l.line")
    quoted = cut(lines.filter("quoted").select("thread_id", "line", F.col("id").alias("later_id")).distinct())
    asked = quoted.select(F.col("thread_id").alias("qt"), F.col("line").alias("ql")).distinct()
    if quoted.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        asked = F.broadcast(asked)
    said = lines.filter("not quoted").join(asked, (F.col("thread_id") == F.col("qt")) & (F.col("line") == F.col("ql")), "left_semi")
    source = said.groupBy(F.col("thread_id").alias("st"), F.col("line").alias("sl")).agg(F.min_by("id", F.struct("t", "id")).alias("earlier_id"))
    links = quoted.join(source, (F.col("thread_id") == F.col("st")) & (F.col("line") == F.col("sl")))
    return links.filter("earlier_id <> later_id").select("earlier_id", "later_id").distinct()


def _constraints(turns: DataFrame, replies: DataFrame) -> DataFrame:
    """(thread, ia, ib, si, sj, gap) of the reply links within one thread."""
    r = replies.select("earlier_id", "later_id").distinct()
    a = turns.select(F.col("id").alias("ia"), F.col("thread_id").alias("thread"), F.col("sender").alias("si"), F.col("t").alias("ti"))
    b = turns.select(F.col("id").alias("ib"), F.col("thread_id").alias("th"), F.col("sender").alias("sj"), F.col("t").alias("tj"))
    both = r.join(a, F.col("earlier_id") == F.col("ia")).join(b, F.col("later_id") == F.col("ib")).filter("thread = th")
    return both.select("thread", "ia", "ib", "si", "sj", (F.col("tj") - F.col("ti")).alias("gap"))


def _settled(turns: DataFrame, links: DataFrame, rounds: int = 1000) -> DataFrame:
    """``turns`` whose replies are not before what they answer: within the tolerance of the fit, a reply's time is raised to that of its source."""
    for _ in range(rounds):
        a, b = (turns.select(F.col("id").alias(f"__{x}"), F.col("t").alias(f"__t{x}")) for x in "ij")
        late = links.join(a, F.col("ia") == F.col("__i")).join(b, F.col("ib") == F.col("__j")).filter("__tj < __ti")
        up = cut(late.groupBy(F.col("ib").alias("__id")).agg(F.max("__ti").alias("__up")))
        if not up.limit(1).count():
            return turns
        turns = cut(turns.join(up, F.col("id") == F.col("__id"), "left").withColumn("t", F.coalesce("__up", "t")).drop("__id", "__up"))
    raise RuntimeError(f"reply times still move after {rounds} rounds")


def ordered_turns(comments: DataFrame, threads: DataFrame, replies: DataFrame | None = None, min_gap: float = 0.0, tolerance: float = 0.5) -> tuple[DataFrame, DataFrame | None]:
    """Ranked turns (thread_id, id, role, turn) of the feasible threads, and the offsets if there are any."""
    c = latest_comments(comments, lines=replies is None).filter("thread_id is not null")
    ts = (F.unix_micros(F.col("created_at").cast("timestamp")) / F.lit(1e6)).alias("t")
    ok_author, ok_time = ~blank(F.col("author")), timed(F.col("created_at"))
    turn = ~F.col("no_body")
    sound = c.groupBy("thread_id").agg(
        F.bool_and(ok_author & ok_time).alias("sound"),
        F.count_if(turn & (F.col("role") == "user")).alias("users"),
        F.count_if(turn & (F.col("role") == "assistant")).alias("bots"),
    ).filter("sound and users > 0 and bots > 0").select(F.col("thread_id").alias("kept"))
    known = threads.select(F.col("id").alias("known")).distinct()
    kept = sound.join(known, F.col("kept") == F.col("known"), "left_semi")
    turns = c.filter(turn).join(kept, F.col("thread_id") == F.col("kept"), "left_semi")
    turns = cut(turns.select("thread_id", "id", F.lower(F.trim("author")).alias("sender"), "role", ts, *(["lines"] if replies is None else [])))
    links = quote_links(turns) if replies is None else replies
    turns = turns.drop("lines")
    constraints = cut(_constraints(turns, links))
    offsets = clock_offsets(constraints, min_gap, tolerance=tolerance)
    if offsets is not None:
        named = turns.select("thread_id", "id", "role", "t", F.col("sender").alias("si"), F.col("thread_id").alias("thread"), F.col("t").alias("gap"))
        n = offsets.count()
        turns = _offset_of(named, offsets, "i", n).select("thread_id", "id", "role", (F.col("t") + F.col("oi")).alias("t"))
    missed = cut(_violated(constraints, offsets, min_gap, n if offsets is not None else 0).filter(F.col("short") > tolerance).select(F.col("thread").alias("bad")).distinct())
    if offsets is not None:
        turns = _settled(cut(turns), constraints.join(missed, F.col("thread") == F.col("bad"), "left_anti"))
    if missed.limit(1).count():
        turns = turns.join(missed, F.col("thread_id") == F.col("bad"), "left_anti")
    return cut(distributed_rank(turns.select("thread_id", "id", "role", "t"), ["thread_id"], ["t", "id"], "turn")), offsets


def conversations(comments: DataFrame, threads: DataFrame, replies: DataFrame | None = None, min_gap: float = 0.0, tolerance: float = 0.5) -> DataFrame:
    """(thread_id, turn, comment_id, role) of every whole conversation.

    Kept are threads in ``threads`` (by ``id``) all of whose comments have a visible author and a
    created_at of the year 2000 or later, with a turn of a user, ending in a turn of the bot, and
    with feasible reply constraints. Comments without a visible body are no turns, but their
    author and time still count for the check. Turns count from 1 by corrected time, then id;
    equal times are told apart by id, repeated rows are one comment, comments of no thread (null
    thread_id) form none. Empty tables give no rows.

    ``replies`` (earlier_id, later_id) are known reply links; without them the links are those of
    quotations. Where the stored times meet all constraints, all offsets are zero and the stored
    order stands.
    """
    ranked, _ = ordered_turns(comments, threads, replies, min_gap, tolerance)
    last = ranked.groupBy("thread_id").agg(F.max_by("role", "turn").alias("closes")).filter("closes = 'assistant'").select(F.col("thread_id").alias("closed"))
    whole = ranked.join(last, F.col("thread_id") == F.col("closed"), "left_semi")
    return whole.select("thread_id", F.col("turn").cast("int").alias("turn"), F.col("id").alias("comment_id"), "role")


def sender_clocks(comments: DataFrame, threads: DataFrame, replies: DataFrame | None = None, min_gap: float = 0.0, tolerance: float = 0.5) -> DataFrame:
    """(sender, offset): the seconds that each sender's clock must be moved by, as ``conversations`` estimates them; senders without a row stay as they are."""
    _, offsets = ordered_turns(comments, threads, replies, min_gap, tolerance)
    return offsets if offsets is not None else comments.sparkSession.createDataFrame([], "sender string, offset double")
