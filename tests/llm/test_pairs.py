"""Defects of answers, and the pairs of threads."""

import random
from datetime import datetime, timedelta

import pytest

from tallyloom.llm.pairs import comment_pairs, defective_pairs, stage_pairs
from tallyloom.llm.textcheck import defect, tiles

Q = "Can you explain why `load_user` has to read the file cli/user.py again after the start?"
SOUND = [
    "Because the cache is dropped at start. It is read once more to fill it.",
    "LGTM", "Done 👍", "Yes, safe to merge.", "Agreed.", "see src/a.py:12", "No, keep it.",
    "Sorry for the late reply. The cache is dropped at start, so the file is read again.",
    "I cannot reproduce the leak locally, but the cause is visible. The cache is never closed.",
    "I can't find any problem in `load_user`. The file is small.",
    "> Can you explain why `load_user` has to read the file\n\nThe cache is dropped at start. Nothing else reads it.",
    "The cache is dropped.\n\n```python\ndef f(a):\n    return g(a)\n```",
    "- The cache is dropped.\n- The file is small.", "- cache dropped\n- file small\n- done again",
    '{"comments": [{"file": "a.go", "line": 3}]}', '```json\n{"a": [1, 2]}\n```', "All is fine.\n\n-- reviewer",
    "Unfortunately the list is still empty at that point. Fill it first.",
    "<details>\n<summary>Why</summary>\nThe cache is dropped.\n</details>", "The type is List<String> here, and a < b holds.",
]
BAD = {
    "empty": [None, "", " \n\t", "n/a", "N/A", "null", "(no output)", "...", "-", '""', "```\n```", "<!-- -->", "​", "{}", "None."],
    "copy": [Q, Q.upper(), f"> {Q}", f"You asked: {Q}", f"Q: {Q}\nA:", f"{Q}\n{Q}", Q.replace("`", "").replace("?", " "), Q.replace("explain ", "")],
    "refusal": ["I'm sorry, but I can't help with that request.", "As an automated reviewer I cannot comment on this anchor.", "Thanks for asking. That question is off limits for me.", "No comment on `x` from my side: my guidelines rule it out.", "Es tut mir leid, dabei kann ich nicht helfen.", "Diese Anfrage muss ich ablehnen, bitte frage das Team.", "Lo siento, no puedo ayudar con esta petición.", "Je ne suis pas autorisé à commenter `a_b`.", "I don't have permission to review this, please ask a maintainer instead.", "Unfortunately I have to decline; policy does not permit me to look into `x`."],
    "truncated": ["The cache is dropped at start, so the file is", "The cache is dropped. It is read once mo", "All is well. The cache,", "The cache is dropped.\n\n```python\ndef f(a):\n    if g(", '{"comments": [{"file": "a.go", "line": 3', '```json\n{"a": [1, 2', "It calls `load_us", "- The cache is dropped.\n- The file is", "<details>\n<summary>Why</summary>\nThe cache is dropped.", "The cache is dropped. See <a href=\"x"],
    "wrong_language": ["Die Datei wird nach dem Start noch einmal gelesen, weil der Speicher leer ist.", "Si deux processus écrivent en même temps, une des modifications est perdue.", "Sin este cambio la conexión queda abierta y la memoria sigue creciendo."],
}


@pytest.mark.parametrize("answer", SOUND)
def test_sound(answer):
    assert defect(Q, answer) is None


@pytest.mark.parametrize(("kind", "answer"), [(k, a) for k, v in BAD.items() for a in v])
def test_defects(kind, answer):
    assert defect(Q, answer) == kind


def test_asked_language():
    german = "Die Datei wird nach dem Start noch einmal gelesen, weil der Speicher leer ist."
    assert defect(f"{Q} Please answer in German.", german) is None
    assert defect(f"{Q} Please answer in German.", SOUND[0]) == "wrong_language"
    assert defect("Was passiert, wenn die Datei nach dem Start noch einmal gelesen wird?", german) is None
    assert defect(None, german) is None


def test_tiles_do_not_overlap():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 25))] for _ in range(2))
        seen_a, seen_b = set(), set()
        for i, j, n in tiles(a, b, 2):
            assert n >= 2 and a[i : i + n] == b[j : j + n]
            assert not seen_a & set(range(i, i + n)) and not seen_b & set(range(j, j + n))
            seen_a |= set(range(i, i + n))
            seen_b |= set(range(j, j + n))


def test_long_texts_are_read_whole():
    long = "The cache is dropped at start. " * 20_000
    assert defect(Q, long) is None
    assert defect(Q, long + "And then it") == "truncated"


C = "id long, thread_id long, author string, body string, is_bot boolean, created_at timestamp, edited_at timestamp, question string"
S = "id long, prompt string, raw_output string, created_at timestamp, pair_id int"
T0 = datetime(2025, 1, 1)


def test_pairs(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [
        (1, 1, "ann", Q, None, at(0), None, ""), (2, 1, "b[bot]", "n/a", None, at(5), None, ""), (3, 1, "b[bot]", "", None, at(6), None, ""),
        (4, 2, "ann", " ", None, at(0), None, ""), (5, 2, "b", "", True, at(1), None, ""),
        (6, 3, "b[bot]", "", True, at(0), None, ""), (7, None, "ann", Q, False, at(0), None, ""), (8, None, "b[bot]", "", True, at(1), None, ""),
        (9, 4, "ann", Q, False, datetime(1970, 1, 1), None, ""), (10, 4, "b[bot]", "", True, at(1), None, ""),
        (11, 5, "ann", Q, False, at(3), None, ""), (12, 5, "b[bot]", "", True, at(3), None, ""), (12, 5, "b[bot]", "LGTM", True, at(3), at(9), ""),
        (2, 1, "b[bot]", "n/a", None, at(5), None, ""), (13, 6, "ann", None, None, at(0), None, ""), (14, 6, "b[bot]", None, None, at(1), None, ""),
    ]
    comments = spark.createDataFrame(rows, C).repartition(3)
    assert {r.pair_id for r in comment_pairs(comments).collect()} == {2, 5, 12, 14}
    stages = spark.createDataFrame([(1, Q, "", at(0), 1), (2, Q, "LGTM", at(0), 1), (1, Q, "", at(0), 1), (3, None, None, None, 1), (None, Q, "", at(0), 1)], S)
    assert stage_pairs(stages).count() == 3
    got = sorted(tuple(r) for r in defective_pairs(stages, comments).collect())
    assert got == [("comment", 2, "empty"), ("comment", 5, "empty"), ("comment", 14, "empty"), ("stage", 1, "empty"), ("stage", 3, "empty")]
    assert defective_pairs(spark.createDataFrame([], S), spark.createDataFrame([], C)).count() == 0
