"""Oversized texts cut at natural boundaries, by structure-tree packing.

A text is parsed into a tree: sections by heading depth (hashes, underlines, heading elements), then
blocks (fenced code, lists, tables, diff hunks, commits, speaker turns, paragraphs), markup elements
and list items, both nested, lines, sentences, words, and within runs without white space what
stands between semicolons or commas. Packing goes bottom up: the pieces of a node are those of its
children; children that fit are merged with their neighbours under the same parent up to the limit,
and only a node that is itself too large is opened, whose pieces are never joined with its siblings'.
A heading that would stand alone goes with the piece after it. Each piece after the first starts
with the last tokens of the one before it, at a word boundary, ``overlap`` tokens or nearly so.
Pieces are spans of the text, so the text is restored from them exactly.

A token is one of a public tokenizer, if its vocabulary file is given; else a longest run of letters,
digits and underscores, or of other visible characters (``\\w+|[^\\w\\s]+``, Unicode).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.packing import encoding

TOKEN = re.compile(r"\w+|[^\w\s]+")
_FENCE = re.compile(r"^[ \t]*(```|~~~)")
_HEADING = re.compile(r"^(#{1,6})[ \t]+\S")
_UNDERLINE = re.compile(r"^(?:(=)=+|(-)-+)[ \t]*$")
_HTML_HEADING = re.compile(r"^[ \t]*<h([1-6])\b", re.I)
#: Markup elements that nest; others stand within lines.
_TAG = re.compile(r"<(/?)(article|aside|blockquote|body|details|div|dl|dd|dt|figure|footer|header|html|li|main|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul)\b[^<>]*?(/?)>", re.I)
_ITEM = re.compile(r"^[ \t]*(?:[-*+•]|\d{1,9}[.)])[ \t]+\S")
#: Line starts that open a block of their own: hunks and files of diffs, commits, speaker turns, definitions.
_OPENS = re.compile(r"^(?:@@ |diff --git |--- [^-]|commit [0-9a-f]{7,40}\b|[0-9a-f]{7,40} \S|[\w\[\].-]{1,40}: \S|(?:async )?def |class |func |type |function |export |public |private |protected |package |import |@\w)")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"')\]»”]*\s+|(?<=[。！？])")

#: How much a boundary divides, from a separator within a run without white space to a section.
MARK, WORD, SENTENCE, LINE, ITEM, ELEMENT, BLOCK, SECTION = range(8)


class Node:
    """A span [a, b) of token numbers with its children, or none for a leaf."""

    __slots__ = ("a", "b", "level", "kids", "heading")

    def __init__(self, a: int, b: int, level: int, kids: list[Node] | None = None) -> None:
        self.a, self.b, self.level, self.kids, self.heading = a, b, level, kids or [], False


def _lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for line in text.splitlines(keepends=True):
        out.append((at, at + len(line)))
        at += len(line)
    return out


def _blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, end, heading depth or 0) of the blocks of a text, in order, without gaps but for blank lines."""
    out: list[tuple[int, int, int]] = []
    begin: int | None = None
    end = 0
    fence = ""
    lines_open = 0

    def close() -> None:
        nonlocal begin
        if begin is not None:
            out.append((begin, end, 0))
            begin = None

    for a, b in _lines(text):
        line = text[a:b]
        mark = _FENCE.match(line)
        if fence:
            end = b
            if mark and mark.group(1) == fence:
                fence = ""
                close()
            continue
        if mark:
            close()
            begin, end, fence = a, b, mark.group(1)
            continue
        if not line.strip():
            close()
            continue
        under = _UNDERLINE.match(line)
        if under and begin is not None and lines_open == 1 and not _ITEM.match(text[begin:end]):
            out.append((begin, b, 1 if under.group(1) else 2))
            begin = None
            continue
        h = _HEADING.match(line)
        element = None if h else _HTML_HEADING.match(line)
        if h or element:
            close()
            out.append((a, b, len(h.group(1)) if h else int(element.group(1))))
            continue
        if begin is None or _OPENS.match(line):
            close()
            begin, lines_open = a, 0
        lines_open += 1
        end = b
    close()
    return out


def _element_cuts(text: str) -> list[int]:
    """Where the outermost elements of a text begin and end; if one holds all others, where its children do."""
    marks: list[tuple[int, int]] = []  # (offset, depth outside)
    stack: list[str] = []
    for m in _TAG.finditer(text):
        name = m.group(2).lower()
        if m.group(3):
            continue
        if not m.group(1):
            marks.append((m.start(), len(stack)))
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
            marks.append((m.end(), len(stack)))
    for depth in sorted({d for _, d in marks}):
        at = [x for x, d in marks if d == depth and text[:x].strip() and text[x:].strip()]
        if at:
            return at
    return []


def _item_cuts(text: str) -> list[int]:
    """Where the list items of the least indentation begin, behind the first line."""
    found = [(m.start(), len(m.group(1).expandtabs(4))) for m in re.finditer(r"(?m)^([ \t]*)(?:[-*+•]|\d{1,9}[.)])[ \t]+\S", text) if m.start() > 0]
    least = min((d for _, d in found), default=0)
    return [x for x, d in found if d == least]


def _cuts(text: str, a: int, b: int, level: int) -> list[int]:
    """Offsets within (a, b) at which the span divides at a level below BLOCK."""
    if level == ELEMENT:
        at = _element_cuts(text[a:b]) if "<" in text[a:b] else []
    elif level == ITEM:
        at = _item_cuts(text[a:b])
    elif level == LINE:
        at = [m.end() for m in re.finditer(r"\r\n|\n|\r|[\x0b\x0c\x1c-\x1e\x85  ]", text[a:b])]
    elif level == SENTENCE:
        at = [m.end() for m in _SENTENCE.finditer(text[a:b])]
    elif level == WORD:
        at = [m.end() for m in re.finditer(r"\s+", text[a:b])]
    else:
        at = [m.end() for m in re.finditer(r"[;；]", text[a:b])] or [m.end() for m in re.finditer(r"[,，、}\])|]", text[a:b])]
    return [a + x for x in at if 0 < x < b - a]


def tree(text: str, starts: list[int], limit: int) -> Node:
    """The structure tree over the tokens that start at ``starts``; nodes of ``limit`` tokens or fewer stay leaves."""

    def first(at: int) -> int:
        return bisect_left(starts, at)

    def below(a: int, b: int, level: int) -> Node:
        ta, tb = first(a), first(b)
        node = Node(ta, tb, level)
        down = level - 1
        while tb - ta > limit and down >= MARK:
            cuts = [c for c in _cuts(text, a, b, down) if ta < first(c) < tb]
            if cuts:
                edges = [a, *cuts, b]
                again = down + 1 if down in (ITEM, ELEMENT) else down  # these nest
                node.kids = [below(x, y, again) for x, y in zip(edges, edges[1:]) if first(y) > first(x)]
                break
            down -= 1
        return node

    blocks = _blocks(text)
    root = Node(0, len(starts), SECTION)
    stack: list[tuple[int, Node]] = [(0, root)]
    for n, (a, _, depth) in enumerate(blocks):
        b = blocks[n + 1][0] if n + 1 < len(blocks) else len(text)
        a = 0 if n == 0 else a
        if depth:
            while stack[-1][0] >= depth:
                stack.pop()
            section = Node(first(a), first(b), SECTION)
            stack[-1][1].kids.append(section)
            stack.append((depth, section))
        leaf = below(a, b, BLOCK)
        leaf.heading = depth > 0
        if leaf.b > leaf.a:
            stack[-1][1].kids.append(leaf)

    def settle(node: Node) -> None:
        for k in node.kids:
            settle(k)
        if node.kids:
            node.a, node.b = node.kids[0].a, node.kids[-1].b

    settle(root)
    root.a, root.b = 0, len(starts)
    return root


def pack(root: Node, limit: int, overlap: int, starts: list[int] | None = None) -> list[tuple[int, int]]:
    """New-token spans of the pieces, bottom up: what fits is merged with its siblings, what is too large is opened.

    The first piece may hold ``limit`` new tokens, later ones ``limit - overlap``. With ``starts``
    no piece ends within a character that is several tokens.
    """

    def fits(a: int, b: int) -> bool:
        return b - a <= (limit if a == 0 else limit - overlap)

    def merged(parts: list[tuple[int, int, bool]], apart: list[bool]) -> list[tuple[int, int]]:
        """Neighbours joined while they fit; ``apart`` marks pieces of opened nodes, the flag of a part a bare heading."""
        out: list[tuple[int, int]] = []
        fixed: list[bool] = []
        bare: list[bool] = []
        for (a, b, heading), own in zip(parts, apart):
            joins = out and fits(out[-1][0], b) and (bare[-1] or not own and not fixed[-1])
            if joins:
                out[-1] = (out[-1][0], b)
                fixed[-1], bare[-1] = own, heading and bare[-1]
            else:
                out.append((a, b))
                fixed.append(own)
                bare.append(heading)
        return out

    def pieces(node: Node) -> list[tuple[int, int]]:
        if fits(node.a, node.b):
            return [(node.a, node.b)]
        if not node.kids:  # one stretch without any boundary
            out, a = [], node.a
            while a < node.b:
                b = most = min(node.b, a + (limit if a == 0 else limit - overlap))
                while starts and a + 1 < b < node.b and starts[b] == starts[b - 1]:
                    b -= 1
                if starts and b < node.b and starts[b] == starts[b - 1]:
                    b = most  # one character of more tokens than a piece holds
                out.append((a, b))
                a = b
            return out
        parts: list[tuple[int, int, bool]] = []
        apart: list[bool] = []
        for k in node.kids:
            if k.b <= k.a:
                continue
            mine = pieces(k)
            parts.extend((*p, k.heading and len(mine) == 1) for p in mine)
            apart.extend([len(mine) > 1] * len(mine))
        return merged(parts, apart)

    return pieces(root)


def _words_only(text: str) -> list[int]:
    return [m.start() for m in TOKEN.finditer(text)]


def tokens_of(path: str | None) -> Callable[[str], list[int]]:
    """Where the tokens of a text begin: of the tokenizer whose vocabulary file is given, else words and marks."""
    if path is None:
        return _words_only
    enc = encoding(path)

    def starts(text: str) -> list[int]:
        return enc.decode_with_offsets(enc.encode_ordinary(text))[1]

    return starts


def split_text(text: str, limit: int = 512, overlap: int = 64, spans_of: Callable[[str], list[int]] = _words_only) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, repeated tokens) of the pieces of a text, as character offsets; one piece if it fits.

    Piece k + 1 repeats the last ``overlap`` tokens of piece k; where the place so found lies
    within a run without white space, the start moves on to the next white space if that is at
    most a quarter of the overlap away. The new parts tile the text: restore it by dropping each
    piece's repeated part.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    starts = spans_of(text)
    n = len(starts)
    if n <= limit:
        return [(0, len(text), n, 0)]
    spans = pack(tree(text, starts, limit - overlap), limit, overlap, starts)

    def inside(k: int) -> bool:
        return k > 0 and not text[starts[k] - 1].isspace() and not text[starts[k]].isspace()

    out = []
    before = 0  # first token of the piece before
    for k, (a, b) in enumerate(spans):
        back = a
        if k:
            back = max(before, a - overlap)
            low = back
            while back < a and back - low < max(1, overlap // 4) and inside(back):
                back += 1
            if back == a or inside(back):
                back = low
            while back < a and starts[back] == starts[back - 1]:  # within one character
                back += 1
        before = back
        end = starts[b] if b < n else len(text)
        out.append((starts[back] if back or k else 0, end, b - back, a - back))
    return out


def _kernel(limit: int, overlap: int, tokenizer: str | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = tokens_of(tokenizer)
        for batch in batches:
            ids: list[int] = []
            no: list[int] = []
            begin: list[int] = []
            stop: list[int] = []
            size: list[int] = []
            again: list[int] = []
            part: list[str] = []
            held = 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(spans_of(text)) <= limit:
                    continue
                for k, (a, b, t, r) in enumerate(split_text(text, limit, overlap, spans_of)):
                    ids.append(i)
                    no.append(k + 1)
                    begin.append(a)
                    stop.append(b)
                    size.append(t)
                    again.append(r)
                    part.append(text[a:b])
                    held += b - a
                    if held > 16_000_000:  # very long texts leave in several batches
                        yield _batch(ids, no, begin, stop, size, again, part)
                        ids, no, begin, stop, size, again, part, held = [], [], [], [], [], [], [], 0
            if ids:
                yield _batch(ids, no, begin, stop, size, again, part)

    return run


_OUT = "doc_id long, piece int, start_char long, end_char long, n_tokens int, n_repeated int, text string"


def _batch(ids, no, begin, stop, size, again, part) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((ids, no, begin, stop, size, again, part), kinds)], names=[c.split()[0] for c in _OUT.split(", ")])


def split_oversized(documents: DataFrame, limit: int = 512, overlap: int = 64, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start_char, end_char, n_tokens, n_repeated, text): the pieces of every text over ``limit`` tokens.

    ``tokenizer`` is the vocabulary file of a public tokenizer; without it words and marks are counted.
    Texts that fit give no rows, nor do null texts or ids; blank texts have no token. A row repeated
    with the same id and text gives its pieces once per row. Line ends of any kind are kept. A run
    without white space or separators that is longer than the limit is cut between tokens, never
    within a character. Further columns are ignored. Map-only: no shuffle; a text of no more than
    ``limit`` bytes can't exceed it and isn't sent to Python.
    """
    docs = documents.select(F.col("doc_id").cast("long"), "text").filter((F.octet_length("text") > limit) & F.col("doc_id").isNotNull())
    return docs.mapInArrow(_kernel(limit, overlap, tokenizer), _OUT)
