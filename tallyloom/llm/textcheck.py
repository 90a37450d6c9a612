"""Checks on one answer to one question: is it empty, a copy, a refusal, cut off, in a wrong language?

Pure Python, no Spark. Truncation is found by a pushdown parser over fences, brackets, quotations,
lists and markup; copies by greedy string tiling; languages by script and letter sequences
(``langid``); refusals by a grammar over classes of words (``refusals``).
"""

from __future__ import annotations

import json
import re
from tallyloom.llm.langid import FREQUENT, LANGUAGES, SAMPLES, Profiles
from tallyloom.llm.refusals import declines

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|\w+")
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})([^\n`]*)$")
#: Texts that stand in for nothing.
STAND_INS = frozenset(
    "n/a na none null nil nan undefined empty blank nothing void tbd todo ... … - -- --- — _ . ? ! {} [] () \"\" '' `` <empty> <none> <null> (empty) (none) (null) (blank) (nothing) "
    "[empty] [none] [null] [blank]".split()
) | frozenset(
    ["no output", "(no output)", "[no output]", "<no output>", "no answer", "(no answer)", "no response", "(no response)", "[no response]", "no content", "(no content)", "no comment", "empty response", "keine antwort", "keine ausgabe", "(keine ausgabe)", "kein inhalt", "leer", "(leer)", "sin respuesta", "sin salida", "(sin salida)", "vacío", "(vacío)", "pas de réponse", "aucune réponse", "aucune sortie", "(aucune sortie)", "vide", "(vide)", "rien", "nada", "nichts"]
)
_INVISIBLE = re.compile(r"[\s­͏؜ᅟᅠ឴឵᠋-᠎​-‏ -‮⁠-⁯ㅤ︀-️﻿ﾠ\x00-\x1f\x7f-\x9f]+")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_EMPTY_TAG = re.compile(r"<(\w+)[^<>]*>\s*</\1>|<(?:br|hr|p)\s*/?>|&nbsp;|&#8203;|&#160;", re.I)


#: Two longer words: no stand-in and no empty JSON looks so.
_READABLE = re.compile(r"^\s*[^\W\d_]{2,}\s+(?:[^\W\d_]+\s+){6,}")


def is_empty(text: str | None) -> bool:
    """Nothing readable, or only a stand-in for nothing."""
    if text is None:
        return True
    t = text
    if "<" in t or "&" in t:
        t = _EMPTY_TAG.sub(" ", _COMMENT.sub(" ", t))
    if "```" in t or "~~~" in t:
        t = re.sub(r"(?m)^[ \t]*(?:`{3,}|~{3,})[\w+-]*[ \t]*$", " ", t)
    if _READABLE.match(t):
        return False
    t = _INVISIBLE.sub(" ", t).strip()
    t = re.sub(r"^(?:[>#*+|-]\s*)+(?=\w|\()|(?<=\w)[\s.!:]+$", "", t)
    low = t.lower().strip("*_`\"' ")
    if not low or low in STAND_INS or t.lower() in STAND_INS:
        return True
    if low.startswith(("{", "[")):
        try:
            v = json.loads(t.strip("` "))
        except ValueError:
            return False
        return v in ({}, [], None, "") or (isinstance(v, dict) and len(v) and all(x in (None, "") for x in v.values()))
    return not re.search(r"\w", low) and not re.search(r"[^\x00-\x7f -⁯]", low)


# ---------------------------------------------------------------- copies


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def tiles(a: list[str], b: list[str], least: int = 3) -> list[tuple[int, int, int]]:
    """Greedy string tiling: maximal common runs (start in a, start in b, length), longest first, none overlapping.

    Runs of ``least`` words are found by hashing, so texts of any length cost about their length.
    """
    used_a, used_b = [False] * len(a), [False] * len(b)
    out: list[tuple[int, int, int]] = []
    where: dict[tuple[str, ...], list[int]] = {}
    for j in range(len(b) - least + 1):
        where.setdefault(tuple(b[j : j + least]), []).append(j)
    found: list[tuple[int, int, int]] = []
    ahead: dict[int, int] = {}  # b position -> length of the run that starts at (i + 1, that position)
    for i in range(len(a) - least, -1, -1):
        now = {}
        for j in where.get(tuple(a[i : i + least]), ()):
            now[j] = ahead.get(j + 1, least - 1) + 1
            found.append((now[j], i, j))
        ahead = now
    for n, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        while n >= least and (used_a[i] or used_b[j]):
            n, i, j = n - 1, i + 1, j + 1
        k = 0
        while k < n and not used_a[i + k] and not used_b[j + k]:
            k += 1
        if k >= least:
            used_a[i : i + k] = [True] * k
            used_b[j : j + k] = [True] * k
            out.append((i, j, k))
    return out


#: What may stand around a copied question without being an answer.
_LEAD = re.compile(r"^\W*(?:you asked|you wrote|question|answer|reply|q|a|frage|antwort|du fragst|pregunta|respuesta|preguntas|question posée|réponse|vous demandez)\s*[:：]\s*", re.I)


def is_copy(question: str, answer: str) -> bool:
    """Hardly anything but the question: nearly all words of the answer lie in tiles of the question, or are a few changed ones between them."""
    q, a = words(question), words(_LEAD.sub("", answer))
    if len(a) < 4 or len(q) < 4:
        return a == q and bool(a)
    own = set(q)
    if sum(w in own for w in a) < 0.8 * len(a):
        return False  # whatever the tiles are
    least = 2 if len(a) < 15 else 3
    tiled = tiles(a, q, least)
    covered = [False] * len(a)
    for i, _, n in tiled:
        covered[i : i + n] = [True] * n
    inside = sum(covered)
    loose = sum(w in own for w, c in zip(a, covered) if not c)
    new = len(a) - inside - loose
    return inside >= 0.5 * len(a) and new <= max(1, 0.2 * len(a)) and inside + loose >= 0.8 * len(a)


# ---------------------------------------------------------------- refusals

_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|\n+")
_CODE = re.compile(r"`[^`\n]*`")

#: Courtesies that carry no answer.
_COURTESY = re.compile(
    r"^\W*(?:sorry|thanks?(?: you)?|thank|many thanks|my apologies|apologies|please|hello|hi|unfortunately|of course|is there anything else|let me know|feel free|ask|contact|reach out|kindly|you will need|you(?:['’]ll)? need to|the (?:security )?team|"
    r"danke|vielen dank|entschuldigung|es tut mir leid|tut mir leid|leider|bitte|wende|hallo|gern|"
    r"gracias|lo siento|lamento|disculp\w+|perdón?|hola|por favor|consulta|pregunta|"
    r"merci|désolée?|je suis désolée?|pardon|bonjour|malheureusement|veuillez|demandez|n['’]hésitez)\b", re.I,
)


def _sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SENTENCE.split(text)) if s]


_PATH = re.compile(r"[\w./-]+/[\w./-]+\.\w+")


def is_refusal(answer: str) -> bool:
    """Declines to answer: sentences that decline, and beside courtesies no more words than these that say anything else."""
    if answer.lstrip().startswith(("{", "[")) and '":' in answer:
        return False  # an answer in the form that was asked for
    refused = rest = 0
    for line in re.split(r"(?s)(```.*?(?:```|\Z))", answer):
        if line.startswith("```"):
            rest += len(WORD.findall(line))
            continue
        for s in _sentences(line):
            plain = _CODE.sub("code", s).strip(" *_>#-")
            if "/" in plain:
                plain = _PATH.sub("path", plain)
            n = plain.count(" ") + 1
            if declines(plain):
                refused += n
            elif not _COURTESY.match(plain):
                rest += n
    return 0 < refused >= rest


# ---------------------------------------------------------------- truncation

_PAIRS = {")": "(", "]": "[", "}": "{"}
#: Sentence ends, also behind closing marks.
_END = re.compile(r"[.!?…。！？:;][\"'”’»)\]}*_`]*$")
_EMOJI_END = re.compile(r"[^\w\s\x00-\x7f¡-ɏ‘-‟]️?$")
_PATH_END = re.compile(r"[\w.-]+/[\w./-]+\.\w+(?::\d+)*$|https?://\S+$")
#: Lines that end a text without a full stop.
_SIGNATURE = re.compile(r"^\s*(?:--|—|–)\s*\S.{0,40}$|^\s*(?:lgtm|done|fixed|agreed|ok|okay|yes|no|ack|nit|wontfix|approved|thanks)\b.{0,20}$", re.I)


def _json_open(text: str) -> bool | None:
    """True if a text that is JSON breaks off, False if it is whole, None if it is no JSON."""
    t = text.strip()
    if not t.startswith(("{", "[")):
        return None
    if t.startswith("[") and re.match(r"\[[^\]\"{}]*\]\(?", t) and not re.match(r"\[\s*(?:[\[{\"\d-]|true|false|null|\])", t):
        return None  # a link or a bracketed word
    if t.startswith("{") and not re.match(r"\{\s*(?:\"|\}|\Z)", t):
        return None
    try:
        json.loads(t)
        return False
    except ValueError:
        pass
    stack: list[str] = []
    quoted = False
    k = 0
    while k < len(t):
        c = t[k]
        if quoted:
            if c == "\\":
                k += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "([{":
            stack.append(c)
        elif c in ")]}":
            if stack and stack[-1] == _PAIRS[c]:
                stack.pop()
            if not stack:
                rest = t[k + 1 :].strip()
                return is_truncated(rest) if rest else False
        k += 1
    return quoted or bool(stack)


#: Markup elements that are always closed.
_ELEMENTS = re.compile(r"<(/?)(details|summary|table|thead|tbody|tr|ul|ol|pre|code|blockquote|div|span|strong|em)\b[^<>]*?(/?)>", re.I)


def _markup_open(prose: str) -> bool:
    """Whether an element that must be closed stays open, or the text ends within a tag."""
    stack: list[str] = []
    for m in _ELEMENTS.finditer(prose):
        name = m.group(2).lower()
        if m.group(3):
            continue
        if not m.group(1):
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
    return bool(stack) or bool(re.search(r"<(?:[a-z][\w-]*(?:\s+[^<>]*)?|/[a-z][\w-]*)$", prose, re.I))


#: Quotation marks that open, with those that close them.
_QUOTES = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』"}


def _prose_open(lines: list[str]) -> bool:
    """Whether prose ends inside a bracket, quotation, code span or emphasis.

    A pushdown parse over all lines. Brackets and quotation marks are pushed and popped across
    lines; code spans and emphasis end with their paragraph (a blank line, item or heading begins a
    new one). Straight quotation marks open before and close behind a word; behind a number they
    are units. What closes nothing (emoticons, "a)") is passed over.
    """
    stack: list[str] = []
    text = "\n".join(lines)
    k, n = 0, len(text)
    while k < n:
        c = text[k]
        if c == "`":
            run = 1
            while k + run < n and text[k + run] == "`":
                run += 1
            end = text.find("`" * run, k + run)
            stop = text.find("\n\n", k)
            if end < 0 and stop < 0:
                return True
            k = end + run if end >= 0 and (stop < 0 or end < stop) else k + run
            continue
        if c == "\\":
            k += 2
            continue
        if c == "\n" and (text.startswith("\n\n", k) or _ITEM_START.match(text, k + 1)):
            stack = [x for x in stack if x != "**"]
        elif c == "*" and text.startswith("**", k):
            if "**" in stack:
                while stack.pop() != "**":
                    pass
            elif k + 2 < n and not text[k + 2].isspace() or k + 2 == n:
                stack.append("**")
            k += 2
            continue
        elif c in "([{":
            if not (c == "(" and k and text[k - 1] in ":;-"):  # an emoticon
                stack.append(c)
        elif c in ")]}":
            if _PAIRS[c] in stack:
                while stack.pop() != _PAIRS[c]:
                    pass
        elif c == '"':
            before, after = text[k - 1] if k else " ", text[k + 1] if k + 1 < n else " "
            if '"' in stack:
                while stack.pop() != '"':
                    pass
            elif not before.isdigit() and not (before.isalpha() and not after.isalnum()):
                stack.append('"')
        elif stack and c in _QUOTES.get(stack[-1], ""):
            stack.pop()
        elif c in _QUOTES:
            stack.append(c)
        k += 1
    return bool(stack)


_ITEM_START = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)]|#{1,6})[ \t]")
#: Words after which a sentence goes on.
DANGLING = frozenset(
    "a an the of to by with and or but is are was were be been from for at as than that which whose because if when while into onto between under its their our your my his her every each no very "
    "der die das ein eine einen einem einer des dem den und oder aber von mit zu für bei aus nach vor über unter durch als wenn weil dass ist sind war wird werden sehr jede jeder kein keine "
    "el la los las un una unos unas de del y o u pero con para por en a al que si cuando porque es son está están muy cada su sus ningún "
    "le les des du une et ou mais de à au aux avec pour par dans sur sous que qui dont si quand parce est sont était très chaque son sa ses leur leurs notre votre "
    "il lo gli di del della e ma per tra che se quando perché è sono il uno os as um uma do da dos das com em não no na het een van voor met en of maar dat wanneer omdat i lub ale z do na że".split()
) - {"no", "at", "a", "over", "on", "in", "war", "i"} | {"a"}


def is_truncated(answer: str) -> bool:
    """Breaks off inside a sentence, code block or JSON.

    Fences are parsed by lines (code whose fence is closed is whole unless it is tagged JSON), whole
    JSON by its own grammar, and all prose by one pushdown parse. Then the last line decides: whether it ends a
    sentence, or in a word after which a sentence goes on. Short whole answers, list items without
    a full stop beside others of that kind, signatures, links and code are whole.
    """
    text = answer.strip()
    if not text:
        return False
    open_ = _json_open(text)
    if open_ is not None:
        return open_
    prose: list[str] = []
    open_lines: list[str] = []  # the prose with its blank lines
    fence = ""
    tag = ""
    code: list[str] = []
    last_code = False
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if fence:
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not m.group(2).strip():
                body = "\n".join(code)
                if tag.lower().startswith("json") and _json_open(body):
                    return True
                fence, last_code = "", True
            else:
                code.append(line)
        elif m:
            fence, tag, code = m.group(1), m.group(2).strip(), []
        elif line.strip():
            prose.append(line)
            open_lines.append(line)
            last_code = False
        else:
            open_lines.append("")
    if fence:
        return True
    if "<" in text:
        if _markup_open(_CODE.sub(" ", "\n".join(prose)).rstrip()):
            return True
        prose = [x for x in (re.sub(r"</?[a-z][^<>]*>", "", p, flags=re.I) for p in prose) if x.strip()]
        if not prose:
            return False
    if last_code:
        return _prose_open(open_lines)
    last = prose[-1].rstrip()
    if _SIGNATURE.match(last):
        return False
    item = re.match(r"^\s*(?:[-*+•]|\d{1,3}[.)])(?:\s+|$)(.*)$", last)
    body = item.group(1).strip() if item else re.sub(r"^\s*(?:>\s?)+", "", last).strip()
    if item and not body:
        return True
    if body.startswith("#") or re.match(r"^\|.*\|$", body):
        return False
    if _prose_open(open_lines):
        return True
    if re.search(r"[,;(\[{]$|\s[-–—]$", body):
        return True
    if _END.search(body) or _EMOJI_END.search(body):
        return body.endswith(":") and not item
    said = words(body)
    if said and said[-1] in DANGLING and body[-1].isalpha():
        return True
    if _PATH_END.search(body) and len(said) <= 12:
        return False
    if len(body) < 4 and not prose[:-1]:
        return False
    if item or len(prose) > 1 and re.match(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s", prose[-2]):
        others = [p.rstrip() for p in prose[:-1] if re.match(r"^\s*(?:[-*+•]|\d{1,3}[.)])\s", p)]
        if others and sum(not _END.search(p) for p in others) * 2 > len(others):
            return False  # items here have no full stop
        if not others and item and len(words(body)) <= 6:
            return False
        return True
    before = " ".join(prose)
    if not re.search(r"[.!?…](?:\s|$)", before[: -len(body)] + " " + body[:-1]) and len(words(body)) <= 8 and re.match(r"^[\"'(*_`]*[^\W\d_a-zß-ÿ]|^[a-z]+ [\w/.:-]+$", body):
        return False  # a short answer without a full stop
    return True


# ---------------------------------------------------------------- languages

#: Frequent function words of four languages, beside the sample texts.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as was be by are this not or have from an at but which we you they its if will can would should there their has been when what who how why before after so than then them these those does do did only because until while into out each every any our your were had he she i'd i'll without nothing else both yet one two".split(),
    "de": "der die das und ist nicht ein eine einer eines einen einem zu den dem des von mit auf für im in sich auch als wie es an werden wird wurde aus bei nach noch nur oder aber wenn dass daß weil kann können bitte ob ich wir du sie er wir haben hat sind war sein ohne damit deshalb bleibt durch über unter vor zum zur beim am diese dieser dieses keine kein mehr immer wieder zwei ihr was warum".split(),
    "es": "el la los las de del que y en un una unos unas es se no por con para al lo como más pero su sus le ya o este esta esto estos estas si porque cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno ni contra otros ese eso ante ellos e son está están fue ser tiene puede qué cómo yo antes después hemos dos".split(),
    "fr": "le la les de des du un une et est en que qui ne pas pour dans ce cette ces il elle on au aux par sur avec plus se son sa ses leur mais ou où si nous vous je j'ai tu ils elles être sont été avant après sans trop car donc quand comme même aussi fait peut qu'il qu'elle c'est n'est d'un d'une lorsque deux y".split(),
}
#: How a question names the language it wants the answer in.
_NAMES = {
    "en": r"english|englisch(?:er|e|en)?|ingl[eé]s|anglais",
    "de": r"german|deutsch(?:er|e|en)?|alem[aá]n|allemand",
    "es": r"spanish|spanisch(?:er|e|en)?|español|castellano|espagnol",
    "fr": r"french|franz[öo]sisch(?:er|e|en)?|franc[eé]s|français",
    "it": r"italian|italienisch(?:er|e|en)?|italiano|italien",
    "pt": r"portuguese|portugiesisch(?:er|e|en)?|portugu[eé]s|português|portugais",
    "nl": r"dutch|niederländisch(?:er|e|en)?|holandés|neerlandés|néerlandais|nederlands",
    "pl": r"polish|polnisch(?:er|e|en)?|polaco|polonais|polsku",
}
_ANY_NAME = re.compile("|".join(_NAMES.values()), re.I)
_WANTED = {k: re.compile(rf"\b(?:in|auf|en|ins)\s+(?:\w+\s+)?(?:{v})\b|\b(?:{v})\s+(?:please|only|bitte|por favor|s['’]il (?:te|vous) pla[iî]t|answer|reply|response)\b", re.I) for k, v in _NAMES.items()}


def _prose(text: str) -> str:
    """The words of a text's prose: without code, quoted lines, paths, links and names of code."""
    t = text
    if "```" in t or "~~~" in t:
        t = re.sub(r"(?s)(`{3,}|~{3,}).*?(?:\1|\Z)", " ", t)
    if "`" in t:
        t = _CODE.sub(" ", t)
    if ">" in t:
        t = re.sub(r"(?m)^\s*>.*$", " ", t)
    j = t.strip()
    if j.startswith(("{", "[")) and '"' in j:
        t = " ".join(re.findall(r'":\s*"((?:\\.|[^"\\])*)"', j))
    kept = []
    for w in t.split():
        if w.isalpha():
            if w.islower() or not w[0].islower():
                kept.append(w)
        elif "/" not in w:
            kept.extend(x for x in _PLAIN.findall(w) if "_" not in x and not any(c.isdigit() for c in x) and (x.islower() or not x[0].islower()))
    return " ".join(kept)


_PLAIN = re.compile(r"\w+(?:['’]\w+)*")
_SCRIPTS = {"ru": "Ѐ-ԯ", "ja": "぀-ヿ", "zh": "一-鿿", "ko": "가-힯", "ar": "؀-ۿ", "he": "֐-׿", "el": "Ͱ-Ͽ", "hi": "ऀ-ॿ", "th": "฀-๿"}
_OTHER = {k: re.compile(f"[{v}]") for k, v in _SCRIPTS.items()}


_LETTER = re.compile(r"[^\W\d_]")
_PROFILES = Profiles(SAMPLES, FREQUENT | FUNCTION_WORDS, words)
#: Evidence beside which a language is told: the lead over another one, in logarithms of likelihood, for a text and for each of its words.
_MARGIN, _MARGIN_A_WORD = 6.0, 0.35


def language_scores(text: str) -> dict[str, float]:
    """How much a text's prose speaks for each language, by its script or its letter sequences; nothing where it has no words."""
    prose = _prose(text)
    if not prose.isascii():
        letters = len(_LETTER.findall(prose))
        for k, p in _OTHER.items():
            n = len(p.findall(prose))
            if n and (n > 0.5 * letters or k == "ja" and n > 0.1 * letters):
                return {k: 100.0 * n}
    ws = prose.lower().replace("’", " ").replace("'", " ").split()
    if not ws:
        return {}
    return dict(zip(LANGUAGES, _PROFILES.score(ws).tolist())) | {"": float(len(ws))}


def _led(score: dict[str, float], best: str, other: float) -> bool:
    return score[best] - other >= max(_MARGIN, _MARGIN_A_WORD * score.get("", 0.0))


def language(text: str) -> str | None:
    """The language of a text's prose, or None where it says too little."""
    score = language_scores(text)
    best = sorted((k for k in score if k), key=lambda k: (-score[k], k))[:2]
    if not best or len(best) > 1 and not _led(score, best[0], score[best[1]]):
        return None
    return best[0]


def wanted_language(question: str) -> str | None:
    """The language a question asks its answer to be in, by name; the last one named counts."""
    if not _ANY_NAME.search(question):
        return None
    prose = _CODE.sub(" ", question)
    found = [(m.start(), k) for k, p in _WANTED.items() for m in p.finditer(prose)]
    return max(found)[1] if found else None


def is_wrong_language(question: str, answer: str) -> bool:
    """Not in the language that the question asks for or, if it asks for none, not in its own."""
    want = wanted_language(question) or language(question)
    score = language_scores(answer)
    if want is None or not score:
        return False
    got = max((k for k in score if k), key=lambda k: (score[k], k))
    return got != want and _led(score, got, score.get(want, min(score.values()) if len(score) > 1 else 0.0))


def defect(question: str | None, answer: str | None) -> str | None:
    """The first defect of an answer, in the order empty, copy, refusal, truncated, wrong_language; None if it is sound."""
    if is_empty(answer):
        return "empty"
    q, a = question or "", answer or ""
    if is_copy(q, a):
        return "copy"
    if is_refusal(a):
        return "refusal"
    if is_truncated(a):
        return "truncated"
    if is_wrong_language(q, a):
        return "wrong_language"
    return None
