"""Pieces: limits, overlap, exact round trip, natural boundaries."""

import os
import re

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from tallyloom.llm.packing import TOKENIZER
from tallyloom.llm.splitting import TOKEN, split_oversized, split_text, tokens_of

PART = st.sampled_from(["# Head\n", "## Sub\n", "word ", "Two words. ", "- item one\n", "\n\n", "\r\n", "```py\ncode(x)\n```\n", "ünïcode ", "a.b.c.d", "!?", "123 ", "@@ -1 +1 @@\n", "bot[x]: hi\n", "日本語。", " ", "\t", " "])


@settings(max_examples=400, deadline=None)
@given(st.lists(PART, max_size=150).map("".join), st.sampled_from([(8, 2), (20, 5), (5, 0), (16, 8)]))
def test_round_trip_limit_and_overlap(text, shape):
    limit, overlap = shape
    pieces = split_text(text, limit, overlap)
    n = len(TOKEN.findall(text))
    if n <= limit:
        assert len(pieces) == 1
        return
    starts = [m.start() for m in TOKEN.finditer(text)]
    assert len(pieces) > 1 and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    whole, done = "", 0
    for k, (a, b, t, r) in enumerate(pieces):
        inside = [s for s in starts if a <= s < b]
        assert len(inside) == t <= limit
        assert a <= done <= b
        if k:
            assert r == sum(a <= s < done for s in starts)
            assert r <= overlap and (r >= overlap - max(1, overlap // 4) or r >= pieces[k - 1][2])
        whole += text[done:b]
        done = b
    assert whole == text


def test_boundaries_are_natural():
    para = "This is a sentence of eight words here. " * 6
    text = "\n\n".join(f"## Part {k}\n\n{para}" for k in range(6))
    pieces = split_text(text, 120, 12)
    assert all(text[b:].startswith("## Part") or b == len(text) for _, b, _, _ in pieces)
    one = "This is a sentence of eight words here. " * 40
    assert all(re.search(r"\. $", one[a:b]) for a, b, _, _ in split_text(one, 60, 6))


def test_operator(spark):
    long = "para graph. " * 400
    rows = [(1, long), (2, "short"), (3, None), (4, ""), (5, " " * 3000), (None, long), (6, "x" * 5000), (7, "a-" * 400_000), (8, long), (8, long)]
    df = spark.createDataFrame([(i, t, 0, "p") for i, t in rows], "doc_id long, text string, piece int, n_tokens string")
    got = split_oversized(df).collect()
    assert {r.doc_id for r in got} == {1, 7, 8}
    assert all(r.n_tokens <= 512 for r in got)
    by = [r for r in got if r.doc_id == 7]
    assert sum(r.n_tokens - r.n_repeated for r in by) == 800_000
    assert split_oversized(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def part(title, words, mark="w"):
    return f"{title}\n\n" + " ".join(f"{mark}{k}" for k in range(words)) + "\n\n"


def test_siblings_are_merged_bottom_up():
    """A small section isn't joined with a part of its large neighbour, whose own parts stay together."""
    text = part("# One", 90) + "# Two\n\n" + "".join(part(f"## Sub {k}", 195) for k in range(4)) + part("# Three", 90) + part("# Four", 90)
    cuts = [text[b:].split("\n")[0] for _, b, _, _ in split_text(text, 512, 64)]
    assert cuts == ["# Two", "## Sub 2", "# Three", ""]


def test_nested_lists_underlined_headings_and_elements():
    def item(depth, k, words):
        return "  " * depth + f"- item{k} " + " ".join(["w"] * words) + "\n"

    text = item(0, 1, 30) + item(1, 2, 30) + item(1, 3, 30) + item(0, 4, 30) + item(1, 5, 30)
    assert [text[b:].lstrip()[:7] for _, b, _, _ in split_text(text, 105, 0)] == ["- item4", ""]
    assert all(text[b:].lstrip()[:6] in ("- item", "") for _, b, _, _ in split_text(text, 70, 0))
    text = part("One\n===", 60) + part("Two\n---", 60) + part("Three\n---", 60)
    assert [text[b:].split("\n")[0] for _, b, _, _ in split_text(text, 70, 0)] == ["Two", "Three", ""]
    rows = "".join(f"<div><p>{'w ' * 20}</p><p>{'v ' * 20}</p></div>\n" for _ in range(4))
    text = f"<section>\n{rows}</section>"
    assert all(text[b:].startswith(("<div>", "</section>")) or b == len(text) for _, b, _, _ in split_text(text, 120, 0))


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")
@settings(max_examples=60, deadline=None)
@given(st.lists(PART, max_size=100).map("".join) | st.text(max_size=200))
@example("0:0\x80¸¼𐀀𐀀0𐀀𐀀")
def test_public_tokenizer(text):
    spans_of, limit = tokens_of(TOKENIZER), 16
    pieces = split_text(text, limit, 4, spans_of)
    done, whole = 0, ""
    for a, b, t, _ in pieces:
        assert a <= done <= b and (t <= limit or len(pieces) == 1)
        whole += text[done:b]
        done = b
    assert whole == text
