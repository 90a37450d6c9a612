"""Text kernels on arbitrary input: they end, don't raise, and keep their invariants."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm.docpairs import module_of, substance
from tallyloom.llm.leakage import item_words, stretch, text_words
from tallyloom.llm.sourceparse import parse
from tallyloom.llm.textcheck import defect, language, wanted_language

BITS = st.sampled_from(["def f(x):", "class A(B):", "async ", '"""', "'''", '"', "'", "`", "/**", "*/", "//", "#", "{", "}", "(", ")", "[", "]", "<", ">", "=>", "=", ";", ":", ",", "\n", "\n\n", "    ", "func ", "function ", "const x", "public int ", "@A", "return ", "name", "\\", "$", "﻿", "\r\n", "ü", "/", "<div>", "</div>", "```\n", "- item", "Sorry, ", "I cannot help. ", '{"a": ', "1. ", "日本"])
TEXT = st.lists(BITS, max_size=60).map("".join) | st.text(max_size=120)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from(["python", "javascript", "typescript", "java", "go", "ruby"]))
def test_parsers(text, lang):
    for f in parse(text, lang).functions:
        assert f.name and f.line_start >= 1
        assert isinstance(substance(f.doc or "", f.name, f.params, f.cls), bool)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_answers(question, answer):
    assert defect(question, answer) in (None, "empty", "copy", "refusal", "truncated", "wrong_language")
    assert language(answer) is None or isinstance(language(answer), str)
    wanted_language(question)
    module_of(question)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=25, max_size=60), st.lists(st.sampled_from("abcdefgh"), max_size=60))
def test_stretch_bounds(item, words):
    n = stretch(item, words, [False] * len(words))
    assert n == 0 or 25 <= n <= len(item)
    assert stretch(item, item, [False] * len(item)) == len(item)
    w, head = text_words(" ".join(words))
    assert len(w) == len(head) and item_words(" ".join(words)) == w
