"""Conversations: rules of keeping, order, roles, clock offsets."""

import random
from datetime import datetime, timedelta

import tallyloom.llm.conversations as module
from tallyloom.llm.conversations import clock_offsets, conversations, sender_clocks

C = "id long, thread_id long, author string, body string, is_bot boolean, created_at timestamp, edited_at timestamp, turn int, known string"
T0 = datetime(2025, 1, 1, 12)


def row(i, thread, author, body="text", bot=None, at=0, edited=None):
    t = None if at is None else (at if isinstance(at, datetime) else T0 + timedelta(seconds=at))
    return (i, thread, author, body, bot, t, edited, 99, "x")


def run(spark, rows, threads=(1, 2, 3, 4, 5, 6, 7, 8, 9), **kw):
    c = spark.createDataFrame(rows, C).repartition(3)
    t = spark.createDataFrame([(x, "x") for x in threads], "id long, known string")
    replies = kw.pop("replies", None)
    if replies is not None:
        replies = spark.createDataFrame(replies, "earlier_id long, later_id long")
    out = {}
    for r in conversations(c, t, replies, **kw).collect():
        out.setdefault(r.thread_id, []).append((r.turn, r.comment_id, r.role))
    return {k: [x[1:] for x in sorted(v)] for k, v in out.items()}


def test_rules(spark):
    rows = [
        row(1, 1, "ann", at=0), row(3, 1, "Bot[BOT] ", at=5), row(2, 1, "bob", at=5),  # tie by id
        row(4, 1, "bob", " \n​", at=9),  # no visible body: no turn
        row(10, 2, "ann", at=0),  # no reply
        row(20, 3, "x", bot=True, at=0), row(21, 3, "x", bot=True, at=1),  # no user
        row(30, 4, "ann", at=0), row(31, 4, " ", bot=True, at=1), row(32, 4, "b[bot]", at=2),  # blank author
        row(40, 5, "ann", at=datetime(1970, 1, 1)), row(41, 5, "b[bot]", at=2),  # no time
        row(50, 6, "ann", at=None), row(51, 6, "b[bot]", at=2),
        row(60, 77, "ann", at=0), row(61, 77, "b[bot]", at=1),  # unknown thread
        row(70, None, "ann", at=0), row(71, None, "b[bot]", at=1),
        row(80, 7, "ann", "old", at=0), row(80, 7, "ann", " ", at=0, edited=T0), row(81, 7, "b[bot]", at=1),  # the latest version is blank
        row(90, 8, "ann", at=0), row(90, 8, "ann", at=0), row(91, 8, "b", bot=True, at=1),  # delivered twice
        row(95, 9, "ann", " ", at=0), row(96, 9, "b", bot=True, at=1),
    ]
    got = run(spark, rows)
    assert got == {1: [(1, "user"), (2, "user"), (3, "assistant")], 8: [(90, "user"), (91, "assistant")]}


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [row(1, 1, "a", at=0), row(2, 1, "b[bot]", at=1)], threads=()) == {}


def test_hot_thread(spark):
    rng = random.Random(5)
    rows = [row(i, 1, rng.choice(["a", "b", "c[bot]"]), "long " * (9000 if i == 7 else 1), at=rng.randrange(300)) for i in range(600)] + [row(9999, 1, "c[bot]", at=1000)]
    got = run(spark, rows)[1]
    want = sorted((r[5], r[0]) for r in rows)
    assert [g[0] for g in got] == [w[1] for w in want]


def test_clock_offsets_restore_the_order(spark):
    """The bot's clock is an hour slow; known reply links give its offset and the true order."""
    rows, links, truth = [], [], {}
    i = 0
    for th in range(1, 10):
        order = []
        for k in range(6):
            i += 1
            who = "ann" if k % 2 == 0 else "b[bot]"
            true = th * 7000 + k * 60
            rows.append(row(i, th, who, at=true - (3600 if who == "b[bot]" else 0)))
            if k:
                links.append((i - 1, i))
            order.append(i)
        truth[th] = order
    got = run(spark, rows, replies=links, min_gap=1.0, tolerance=5.0)
    assert {k: [x[0] for x in v] for k, v in got.items()} == truth


def test_infeasible_links_are_rejected(spark):
    """A pair of links that contradict each other; the sound threads outweigh it in the offsets."""
    rows = [r for th in range(1, 31) for r in (row(2 * th, th, "ann", at=0), row(2 * th + 1, th, "b[bot]", at=60))]
    links = [(2 * th, 2 * th + 1) for th in range(1, 31)] + [(5, 4)]
    got = run(spark, rows, threads=range(1, 31), replies=links, min_gap=30.0, tolerance=10.0)
    assert set(got) == set(range(1, 31)) - {2}


def test_offsets_are_none_when_all_holds(spark):
    df = spark.createDataFrame([(1, "a", "b", 3.0)], "thread long, si string, sj string, gap double")
    assert clock_offsets(df) is None


def test_quotes_are_constraints(spark):
    """Replies quote what a slow clock shows as later: the offset comes from the quotations alone, a contradictory thread is rejected."""
    rows = []
    for th in range(1, 8):
        rows.append(row(10 * th, th, "ann", f"Why is lock number {th} taken?\nIt is slow.", at=7000 * th))
        rows.append(row(10 * th + 1, th, "b[bot]", f"> Why is lock number  {th} taken?\n\nIt guards the map.", at=7000 * th + 30 - 900))
    rows += [row(90, 9, "ann", "> the last word\nthe first word", at=0), row(91, 9, "ann", "> the first word\nthe last word", at=50), row(92, 9, "b[bot]", "yes", at=5000)]
    got = run(spark, rows)
    assert got == {th: [(10 * th, "user"), (10 * th + 1, "assistant")] for th in range(1, 8)}
    c = spark.createDataFrame(rows, C)
    t = spark.createDataFrame([(x,) for x in range(1, 10)], "id long")
    clocks = {r.sender: r.offset for r in sender_clocks(c, t).collect()}
    assert clocks["b[bot]"] - clocks["ann"] >= 870 - 0.5


def test_salted_senders_equal_broadcast(spark, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_SENDERS", 0)
    monkeypatch.setattr(module, "BROADCAST_LINES", 0)
    test_quotes_are_constraints(spark)
