"""Tolerant parsers: functions, their documentation and class hierarchies of one source file.

Each parser first splits the text into tokens, so comments, strings, templates and raw strings are
told from code, and then follows brackets and indentation. Files that break off or don't parse
give what stands before and after the broken place. Pure Python, no Spark.
"""

from __future__ import annotations

import ast
import inspect
import re
import warnings
from dataclasses import dataclass, field

#: Extensions of the five languages.
LANGUAGES = {".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".go": "go", ".java": "java"}


@dataclass
class Function:
    name: str
    cls: str
    params: list[str]
    signature: str
    line_start: int
    doc: str | None = None  # cleaned documentation, None if there is none


@dataclass
class Parsed:
    functions: list[Function] = field(default_factory=list)
    classes: list[tuple[str, list[str]]] = field(default_factory=list)  # (name, bases)


def language_of(path: str, lang: str | None) -> str | None:
    """By extension; by the given language only where the extension says nothing."""
    base = path.rsplit("/", 1)[-1]
    ext = "." + base.rsplit(".", 1)[-1].lower() if "." in base else ""
    return LANGUAGES.get(ext) or (lang or "").strip().lower() or None


def parse(text: str, lang: str) -> Parsed:
    """Functions and classes of a file; nothing for languages without a parser."""
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    if lang == "python":
        return _python(text)
    if lang == "go":
        return _go(text)
    if lang in ("javascript", "typescript", "java"):
        return _braces(text, lang)
    return Parsed()


def _flat(text: str) -> str:
    return " ".join(text.split())


# ---------------------------------------------------------------- Python

_PY = re.compile(
    r"""(?P<str>(?P<pre>[A-Za-z]{0,2})(?P<q>'''|\"\"\"|'|"))"""
    r"""|(?P<comment>\#[^\n]*)|(?P<id>[^\W\d]\w*)|(?P<nl>\n)|(?P<cont>\\\n)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<op>[^\s\w])|(?P<num>\d\w*)"""
)
_STRING_PREFIX = {"", "r", "u", "b", "f", "br", "rb", "fr", "rf", "t", "tr", "rt"}


def _py_tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end); strings have kind ``str`` or, if unterminated, ``cut``."""
    out: list[tuple[str, str, int, int]] = []
    at, n = 0, len(text)
    while at < n:
        m = _PY.match(text, at)
        if not m:
            at += 1
            continue
        kind = m.lastgroup if m.lastgroup not in ("pre", "q") else "str"
        if kind == "str":
            if m.group("pre").lower() not in _STRING_PREFIX:
                out.append(("id", m.group("pre"), at, m.start("q")))
                at = m.start("q")
                continue
            q = m.group("q")
            k = m.end()
            closed = False
            while k < n:
                c = text[k]
                if c == "\\":
                    k += 2
                elif text.startswith(q, k):
                    k += len(q)
                    closed = True
                    break
                elif c == "\n" and len(q) == 1:
                    break
                else:
                    k += 1
            k = min(k, n)
            out.append(("str" if closed else "cut", text[at:k], at, k))
            at = k
            continue
        out.append((kind or "op", m.group(), at, m.end()))
        at = m.end()
    return out


def _py_doc(literal: str) -> str | None:
    m = re.match(r"([A-Za-z]{0,2})('''|\"\"\"|'|\")", literal)
    if not m or set(m.group(1).lower()) & set("bft"):
        return None
    if "\\" in literal:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return inspect.cleandoc(ast.literal_eval(literal))
        except (SyntaxError, ValueError):
            pass
    return inspect.cleandoc(literal[m.end() : -len(m.group(2))])


def _py_params(tokens: list[tuple[str, str, int, int]]) -> list[str]:
    out, depth, fresh = [], 0, True
    for kind, t, _, _ in tokens:
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth -= 1
        elif depth == 1 and t == ",":
            fresh = True
        elif depth == 1 and kind == "id" and fresh:
            out.append(t)
            fresh = False
        elif depth == 1 and t in ":=":
            fresh = False
    return out


def _python(text: str) -> Parsed:
    tokens = _py_tokens(text)
    out = Parsed()
    scopes: list[tuple[int, str, str]] = []  # (indent, kind, name)
    depth = 0
    line_start = True
    k, n = 0, len(tokens)
    while k < n:
        kind, t, a, _ = tokens[k]
        if kind == "nl":
            line_start = True
            k += 1
            continue
        if kind in ("comment", "cont"):
            k += 1
            continue
        begins = line_start and kind == "id" and text[text.rfind("\n", 0, a) + 1 : a].strip() == ""
        line_start = False
        if begins and t in ("def", "class", "async"):
            depth = 0  # no statement stands within brackets: those before were left open
        if not begins or depth or t not in ("def", "class", "async"):
            depth += (kind == "open") - (kind == "close")
            depth = max(0, depth)
            k += 1
            continue
        head = k
        if t == "async":
            if k + 1 >= n or tokens[k + 1][1] != "def":
                k += 1
                continue
            k += 1
        word = tokens[k][1]
        if k + 1 >= n or tokens[k + 1][0] != "id":
            k += 1
            continue
        name = tokens[k + 1][1]
        indent = len(text[text.rfind("\n", 0, a) + 1 : a].expandtabs(8))
        while scopes and scopes[-1][0] >= indent:
            scopes.pop()
        # the header runs to the colon outside brackets
        j, d, ok = k + 2, 0, False
        while j < n:
            jk, jt, ja, _ = tokens[j]
            if jk == "open":
                d += 1
            elif jk == "close":
                d -= 1
            elif jt == ":" and d == 0:
                ok = True
                break
            elif jk == "nl" and d == 0:
                break
            elif d > 0 and jk == "id" and jt in ("def", "class") and text[text.rfind("\n", 0, ja) + 1 : ja].strip() == "":
                break
            j += 1
        if not ok:
            k, line_start = j, True
            continue
        if word == "class":
            bases, d, last = [], 0, ""
            for jk, jt, _, _ in tokens[k + 2 : j]:
                if jk == "open":
                    d += 1
                elif jk == "close" or (jt == "," and d == 1):
                    if last and d == 1:
                        bases.append(last)
                    last = ""
                    d -= jk == "close"
                elif d == 1 and jk == "id":
                    last = jt
                elif d == 1 and jt == "=":
                    last = ""
            out.classes.append((".".join([*(s[2] for s in scopes if s[1] == "class"), name]), [b for b in bases if b != "object"]))
            scopes.append((indent, "class", name))
            k = j + 1
            continue
        owner: list[str] = []
        for s in reversed(scopes):
            if s[1] != "class":
                break
            owner.insert(0, s[2])
        f = Function(name, ".".join(owner), [p for p in _py_params(tokens[k + 2 : j])], _flat(text[tokens[head][2] : tokens[j][2]]), text.count("\n", 0, a) + 1)
        b = j + 1
        lines = False
        while b < n and tokens[b][0] in ("nl", "comment", "cont"):
            lines |= tokens[b][0] == "nl"
            b += 1
        if b < n and tokens[b][0] == "str":
            inside = not lines or len(text[text.rfind("\n", 0, tokens[b][2]) + 1 : tokens[b][2]].expandtabs(8)) > indent
            parts = []
            e = b
            while e < n and tokens[e][0] == "str":
                parts.append(_py_doc(tokens[e][1]))
                e += 1
            ends = e >= n or tokens[e][0] in ("nl", "comment") or tokens[e][1] == ";"
            if inside and ends and None not in parts:
                f.doc = "".join(p or "" for p in parts)
        out.functions.append(f)
        scopes.append((indent, "def", name))
        line_start = False
        k = j + 1
    return out


# ---------------------------------------------------------------- Java, JavaScript, TypeScript

_C = re.compile(
    r"""(?P<doc>/\*\*(?!/).*?\*/)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<line>//[^\n]*)"""
    r"""|(?P<text>\"\"\".*?(?:(?<!\\)\"\"\"|\Z))|(?P<tpl>`(?:\\.|[^`\\])*(?:`|\Z))|(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)"""
    r"""|(?P<id>[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d][\w$]*)|(?P<num>\d[\w.]*)|(?P<arrow>=>)|(?P<nl>\n)|(?P<op>[^\s\w])""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words that are followed by parentheses or names and declare no function.
_CALLS = {"if", "for", "while", "switch", "catch", "return", "new", "throw", "function", "super", "this", "typeof", "await", "yield", "else", "do", "try", "synchronized", "assert", "case", "delete", "void", "in", "of", "instanceof", "with", "import"}
_MODIFIERS = {"export", "default", "async", "function", "*", "declare", "static", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "final", "const", "let", "var", "native", "strictfp", "transient", "volatile"}
#: Comments for tools, which may stand between documentation and function and are no documentation.
_DIRECTIVE = re.compile(r"^(?://|/\*)\s*(?:eslint|tslint|jshint|jslint|prettier|@ts-|istanbul|c8|v8|webpack|noinspection|NOSONAR|CHECKSTYLE|spotless|biome|stylelint|#__|@__|<reference|global\b|language=)", re.I)
_BLANK_LINE = re.compile(r"\n[ \t]*\n")


def _c_doc(block: str) -> str:
    body = block[3:-2]
    lines = [re.sub(r"^[ \t]*\*?[ \t]?", "", x) if k else x.strip() for k, x in enumerate(body.split("\n"))]
    return inspect.cleandoc("\n".join(x.rstrip() for x in lines)).strip()


def _c_tokens(text: str, lang: str) -> list[tuple[str, str, int, int]]:
    out: list[tuple[str, str, int, int]] = []
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if c == "/" and lang != "java" and not text.startswith(("//", "/*"), at):
            prev = next((x for x in reversed(out) if x[0] not in ("doc", "block", "line")), None)
            if prev is None or prev[0] == "arrow" or (prev[0] == "op" and prev[1] in "=(,:[!&|?{};+-*%<>~^") or prev[1] in ("return", "typeof", "case", "in", "of"):
                m = _REGEX.match(text, at)
                if m:
                    out.append(("str", m.group(), at, m.end()))
                    at = m.end()
                    continue
        m = _C.match(text, at)
        if not m:
            at += 1
            continue
        kind = m.lastgroup or "op"
        if kind == "text" and lang != "java":
            m = re.compile(r'"(?:\\.|[^"\\\n])*"?').match(text, at)
            kind = "str"
        if kind == "tpl" and lang == "java":
            at += 1
            continue
        if kind != "nl":
            out.append((kind, m.group(), at, m.end()))
        at = m.end()
    return out


def _match(tokens: list[tuple[str, str, int, int]], k: int, open_: str, close: str) -> int:
    """Index of the token that closes the bracket at k, or -1."""
    d = 0
    for j in range(k, len(tokens)):
        t = tokens[j][1]
        if tokens[j][0] == "op":
            d += (t == open_) - (t == close)
            if d == 0:
                return j
    return -1


def _angle(tokens: list[tuple[str, str, int, int]], k: int) -> int:
    """Index behind a balanced <...> at k, or k if it isn't one."""
    d = 0
    for j in range(k, min(len(tokens), k + 60)):
        t = tokens[j][1]
        if t == "<":
            d += 1
        elif t == ">":
            d -= 1
            if d == 0:
                return j + 1
        elif t in ";{)":
            return k
    return k


def _c_params(tokens: list[tuple[str, str, int, int]], lang: str) -> list[str]:
    out: list[str] = []
    depth, part = 0, []
    for tok in [*tokens[1:-1], ("op", ",", 0, 0)]:
        t = tok[1]
        if t in "([{<" and tok[0] == "op":
            depth += 1
        elif t in ")]}>" and tok[0] == "op":
            depth -= 1
        if t == "," and depth <= 0:
            ids = [x for x, y in part if y == 0]
            if ids:
                out.append(ids[-1] if lang == "java" else ids[0])
            part = []
        elif tok[0] == "id":
            part.append((t, depth))
        elif t in ":=" and lang != "java" and depth == 0 and part:
            part = part[:1] + [(x, 9) for x, _ in part[1:]]
    return out


def _braces(text: str, lang: str) -> Parsed:
    tokens = _c_tokens(text, lang)
    out = Parsed()
    n = len(tokens)
    stack: list[tuple[str, str]] = []  # ("class", name) or ("block", "")
    doc: int | None = None  # token of the documentation that may belong to what comes
    start: int | None = None  # first token of the declaration at hand
    pending: tuple[str, list[str]] | None = None  # class whose body opens next
    k = 0

    def documented(name_at: int) -> str | None:
        if doc is None or start is None:
            return None
        if _BLANK_LINE.search(text, tokens[doc][3], tokens[name_at][2]):
            return None
        return _c_doc(tokens[doc][1])

    def clean(a: int, b: int) -> bool:
        """Whether only modifiers and annotations stand between two tokens."""
        j = a
        while j < b:
            t = tokens[j]
            if t[1] == "@":
                j += 2
                while j + 1 < b and tokens[j][1] == ".":
                    j += 2
                if j < b and tokens[j][1] == "(":
                    j = _match(tokens, j, "(", ")") + 1
                    if j == 0:
                        return False
                continue
            if t[0] in ("line", "block") and _DIRECTIVE.match(t[1]):
                j += 1
                continue
            if t[1] not in _MODIFIERS:
                return False
            j += 1
        return True

    def classes() -> str:
        return ".".join(x for kind, x in stack if kind == "class")

    def add(name_at: int, p: int, q: int, end: int, owner: str) -> None:
        first = start if start is not None else name_at
        while first < name_at and (tokens[first][0] in ("line", "block") or tokens[first][1] == "@"):
            first += 1
            if tokens[first - 1][1] == "@":
                first += 1
                if first < name_at and tokens[first][1] == "(":
                    first = _match(tokens, first, "(", ")") + 1
        params = _c_params(tokens[p : q + 1], lang) if tokens[p][1] == "(" else [tokens[p][1]]
        out.functions.append(Function(tokens[name_at][1].lstrip("#"), owner, params, _flat(text[tokens[first][2] : tokens[end][3]]), text.count("\n", 0, tokens[name_at][2]) + 1, documented(name_at)))

    while k < n:
        kind, t, a, b = tokens[k]
        if kind == "doc":
            doc, start = k, None
            k += 1
            continue
        if kind in ("line", "block"):
            if doc is not None and not _DIRECTIVE.match(t):
                doc = None
            k += 1
            continue
        if start is None:
            start = k
        if kind == "op" and t in "{};":
            if t == "{":
                if pending:
                    out.classes.append((".".join(x for x in (classes(), pending[0]) if x), pending[1]))
                    stack.append(("class", pending[0]))
                    pending = None
                else:
                    stack.append(("block", ""))
            elif t == "}":
                if stack:
                    stack.pop()
            doc = start = None
            k += 1
            continue
        if kind == "op" and t == "@" and k + 1 < n and tokens[k + 1][1] != "interface":
            k += 2
            while k + 1 < n and tokens[k][1] == ".":
                k += 2
            if k < n and tokens[k][1] == "(":
                j = _match(tokens, k, "(", ")")
                k = j + 1 if j >= 0 else n
            continue
        if kind == "id" and t in ("class", "interface", "enum", "record") and k + 1 < n and tokens[k + 1][0] == "id" and (k == 0 or tokens[k - 1][1] != "."):
            j = k + 2
            bases: list[str] = []
            heard = False
            while j < n and tokens[j][1] not in ("{", ";"):
                if tokens[j][1] == "<":
                    j = max(_angle(tokens, j), j + 1)
                    continue
                if tokens[j][1] == "(":
                    j = max(_match(tokens, j, "(", ")"), j) + 1
                    continue
                if tokens[j][1] in ("extends", "implements"):
                    heard = True
                elif heard and tokens[j][0] == "id":
                    if tokens[j - 1][1] == "." and bases:
                        bases[-1] = tokens[j][1]
                    else:
                        bases.append(tokens[j][1])
                j += 1
            if j < n and tokens[j][1] == "{":
                pending = (tokens[k + 1][1], bases)
            k = j
            continue
        top = stack[-1] if stack else ("block", "")
        if kind == "id" and lang != "java" and t == "function":
            j = k + 1
            if j < n and tokens[j][1] == "*":
                j += 1
            if j < n and tokens[j][0] == "id":
                p = j + 1
                if p < n and tokens[p][1] == "<":
                    p = _angle(tokens, p)
                if p < n and tokens[p][1] == "(":
                    q = _match(tokens, p, "(", ")")
                    if q >= 0:
                        if start is not None and not clean(start, j):
                            doc = None
                        add(j, p, q, q, classes() if top[0] == "class" else "")
                        k = q + 1
                        k = _type_end(tokens, k) if k < n and tokens[k][1] == ":" else k
                        continue
            k += 1
            continue
        if kind == "id" and lang != "java" and k + 1 < n and (tokens[k - 1][1] in ("const", "let", "var") if k else False) or (kind == "id" and lang != "java" and top[0] == "class" and k + 1 < n and tokens[k + 1][1] in "=:?!" and t not in _CALLS):
            j = k + 1
            if tokens[j][1] in "?!" and j + 1 < n:
                j += 1
            if tokens[j][1] == ":":
                j = _type_end(tokens, j, "=")
            if j < n and tokens[j][1] == "=" and (j + 1 >= n or tokens[j + 1][1] != "="):
                p = j + 1
                if p < n and tokens[p][1] == "async":
                    p += 1
                found = False
                if p < n and tokens[p][1] == "function":
                    p += 1
                    p += p < n and tokens[p][1] == "*"
                    p += p < n and tokens[p][0] == "id"
                    found = p < n and tokens[p][1] == "("
                    q = _match(tokens, p, "(", ")") if found else -1
                    found = q >= 0
                else:
                    if p < n and tokens[p][1] == "<":
                        p = _angle(tokens, p)
                    if p < n and tokens[p][1] == "(":
                        q = _match(tokens, p, "(", ")")
                        r = q + 1
                        if q >= 0 and r < n and tokens[r][1] == ":":
                            r = _type_end(tokens, r, "=>")
                        found = q >= 0 and r < n and tokens[r][0] == "arrow"
                    elif p + 1 < n and tokens[p][0] == "id" and tokens[p + 1][0] == "arrow":
                        q = p
                        found = True
                if found:
                    if start is not None and not clean(start, k):
                        doc = None
                    add(k, p, q, q, classes() if top[0] == "class" else "")
                    k = q + 1
                    k = _type_end(tokens, k, "=>") if k < n and tokens[k][1] == ":" else k
                    continue
            k += 1
            continue
        if kind == "id" and top[0] == "class" and pending is None and t not in _CALLS and k + 1 < n and tokens[k + 1][1] in "(<":
            p = k + 1
            if tokens[p][1] == "<":
                p = _angle(tokens, p)
            if p < n and tokens[p][1] == "(":
                q = _match(tokens, p, "(", ")")
                prev = tokens[k - 1][1] if k else ""
                if q >= 0 and prev not in ("=", ".", "new", ",", "->", "&", "|", "?"):
                    r = q + 1
                    if lang == "java":
                        while r < n and (tokens[r][0] == "id" or tokens[r][1] in ".,[]<>@?"):
                            r += 1
                    elif r < n and tokens[r][1] == ":":
                        r = _type_end(tokens, r)
                    body = r >= n or tokens[r][1] == "{" or (tokens[r][1] == ";" and lang != "javascript")
                    if body:
                        if lang != "java" and start is not None and not clean(start, k):
                            doc = None
                        add(k, p, q, q, classes())
                        k = r
                        continue
                k = (q if q >= 0 else k) + 1
                continue
        if kind == "op" and t == "(":
            j = _match(tokens, k, "(", ")")
            # look inside for functions of callbacks only if it closes; brackets left open end the search for members
            k = k + 1 if j < 0 or any(x[1] == "{" for x in tokens[k:j]) else j + 1
            continue
        k += 1
    return out


def _type_end(tokens: list[tuple[str, str, int, int]], k: int, until: str = "{") -> int:
    """Index of the token that ends the type annotation whose colon is at k."""
    j, d = k + 1, 0
    while j < len(tokens):
        kind, t, _, _ = tokens[j]
        if d == 0 and (t == until or t in (";", ",") or (kind == "arrow" and until == "=>")) and not (t == "{" and j == k + 1):
            return j
        if kind == "op":
            if t in "<([{":
                d += 1
            elif t in ">)]}":
                if d == 0:
                    return j
                d -= 1
        j += 1
    return j


# ---------------------------------------------------------------- Go

_GO = re.compile(
    r"""(?P<block>/\*.*?(?:\*/|\Z))|(?P<line>//[^\n]*)|(?P<raw>`[^`]*(?:`|\Z))|(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)"""
    r"""|(?P<id>[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<nl>\n)|(?P<op>[^\s\w])""",
    re.S,
)
#: Directives are no documentation: //go:noinline, //nolint, //export, //line, // +build.
_GO_DIRECTIVE = re.compile(r"^//(?:[a-z0-9]+:[a-zA-Z0-9]|nolint\b|export |extern |line |\s*\+build\b)")


def _go(text: str) -> Parsed:
    tokens = [(m.lastgroup or "op", m.group(), m.start(), m.end()) for m in _GO.finditer(text)]
    out = Parsed()
    n = len(tokens)
    lines: list[tuple[int, str]] = []  # the run of // lines right above: (line number, text)
    depth = 0
    row = 1
    fresh = True
    k = 0
    while k < n:
        kind, t, a, b = tokens[k]
        if kind == "nl":
            row += 1
            fresh = True
            k += 1
            continue
        if kind in ("line",) and fresh and depth == 0:
            if lines and lines[-1][0] != row - 1:
                lines = []
            lines.append((row, t))
            fresh = False
            k += 1
            continue
        if kind in ("block", "raw", "str"):
            row += t.count("\n")
            if kind == "block":
                lines = []
            fresh = False
            k += 1
            continue
        if fresh and depth == 0 and kind == "id" and t == "func":
            j = k + 1
            owner = ""
            if j < n and tokens[j][1] == "(":
                q = _match(tokens, j, "(", ")")
                if q < 0:
                    k += 1
                    continue
                ids = [x[1] for x in tokens[j + 1 : q] if x[0] == "id"]
                cutoff = next((i for i, x in enumerate(tokens[j + 1 : q]) if x[1] == "["), None)
                if cutoff is not None:
                    ids = [x[1] for x in tokens[j + 1 : j + 1 + cutoff] if x[0] == "id"]
                owner = ids[-1] if ids else ""
                j = q + 1
            if j < n and tokens[j][0] == "id":
                p = j + 1
                if p < n and tokens[p][1] == "[":
                    p = _match(tokens, p, "[", "]") + 1 or p
                if p < n and tokens[p][1] == "(":
                    q = _match(tokens, p, "(", ")")
                    if q >= 0:
                        e = q + 1
                        d = 0
                        while e < n and not (d == 0 and tokens[e][1] == "{") and tokens[e][0] != "nl":
                            d += (tokens[e][1] in "([") - (tokens[e][1] in ")]")
                            e += 1
                        doc = None
                        if lines and lines[-1][0] == row - 1:
                            kept = [x for _, x in lines if not _GO_DIRECTIVE.match(x)]
                            doc = "\n".join(re.sub(r"^//[ \t]?", "", x) for x in kept).strip() if kept else None
                        out.functions.append(Function(tokens[j][1], owner, _go_params(tokens[p + 1 : q]), _flat(text[a : tokens[e - 1][3]]), row, doc))
                        row += text.count("\n", a, tokens[q][3])
                        lines, fresh = [], False
                        k = q + 1
                        continue
        if fresh and depth == 0 and kind == "id" and t == "type" and k + 2 < n and tokens[k + 2][1] == "struct":
            q = _match(tokens, k + 3, "{", "}") if k + 3 < n and tokens[k + 3][1] == "{" else -1
            body = text[tokens[k + 3][3] : tokens[q][2]] if q >= 0 else ""
            out.classes.append((tokens[k + 1][1], re.findall(r"(?m)^[ \t]*\*?(?:\w+\.)?([A-Z]\w*)[ \t]*$", body)))
        if kind == "op":
            depth += (t in "{(") - (t in "})")
            depth = max(0, depth)
        if fresh and depth == 0 and kind != "line":
            lines = []
        fresh = False
        k += 1
    return out


def _go_params(tokens: list[tuple[str, str, int, int]]) -> list[str]:
    out, d, fresh = [], 0, True
    for kind, t, _, _ in tokens:
        if kind == "op" and t in "([{":
            d += 1
        elif kind == "op" and t in ")]}":
            d -= 1
        elif t == "," and d == 0:
            fresh = True
        elif fresh and kind == "id":
            out.append(t)
            fresh = False
    return out
