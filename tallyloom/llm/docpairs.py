"""Functions paired with their documentation.

Every source file is parsed (``sourceparse``) into functions with signature and documentation and
into class hierarchies. A base is the class of that name in the same file, else the only one in the
same folder, else the only one in the same repository. Every function then looks for documentation:
first its own, then, level by level, that of the method of its name in the bases of its class, until
no class is left that wasn't visited. Documentation that is missing, only an inherit tag, or says
nothing doesn't count; a function without any is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.sourceparse import language_of, parse
from tallyloom.session import Rounds

#: What marks documentation still to be written, or left out.
_PLACEHOLDERS = (
    r"(?:todo|fixme|tbd|tba|tbc|xxx|wip|hack)\b.*",
    r"n\s*/?\s*a\b",
    r"(?:none|null|nil|undocumented|unknown|placeholder|lorem ipsum.*|_?(?:summary|description|type|doc|docs|docstring|documentation|comment|text|name)_?)",
    r"(?:please\s+)?(?:add|insert|write|provide|put|enter|fill in|fill out|complete|supply|give|type|describe|document)\b.*\b(?:doc|docs|documentation|docstring|description|comment|summary|details|text|here|later|me|this|it)\b.*",
    r"(?:please\s+)?document (?:me|this|it)\b.*",
    r"(?:see|cf\.?) (?:above|below|elsewhere|there|code|source)|(?:still )?(?:a )?work in progress\b.*|(?:old|new|first|draft|temporary) version|(?:more|details|docs) (?:later|soon)|(?:come|check) back later",
    r"(?:this is an? )?auto[- ]?generated\b.*",
    r"(?:this |the )?(?:comment|docstring|documentation|description|doc|block|page)s? (?:is |was )?(?:intentionally |deliberately )?(?:left )?(?:blank|empty|missing|pending|needed|required)\b.*",
    r"(?:no|missing|needs?) (?:documentation|description|docstring|docs?|comments?)\b.*",
    r"(?:documentation|description|docs?|details|docstring)\s+(?:to come|to follow|coming soon|pending|goes here|here|needed|missing|follows)\b.*",
    r"(?:still )?(?:to be|not yet|needs to be) (?:documented|written|done|defined|determined|added|completed|described|filled in)\b.*",
    r"(?:bitte\s+)?(?:beschreibung|dokumentation)\b.*\b(?:hier|einfügen|ergänzen|fehlt|folgt)\b.*|(?:noch )?zu dokumentieren.*|(?:fehlende|keine) (?:beschreibung|dokumentation).*",
    r"(?:añadir|agregar|insertar|escribir|por) (?:la )?(?:descripción|documentación|documentar|describir)\b.*|sin (?:descripción|documentación).*|pendiente de documentar.*",
    r"(?:ajouter|insérer|écrire|à) (?:la )?(?:description|documentation|documenter|compléter|rédiger)\b.*|(?:pas de|sans) (?:documentation|description).*",
)
_PLACEHOLDER = re.compile(rf"^(?:{'|'.join(_PLACEHOLDERS)})[\s.!:…]*$", re.I)
_INHERIT = re.compile(r"\{\s*@inherit[- ]?doc\s*\}|@inherit[- ]?doc\b|:inherit(?:ed)?-?doc:|\binheritdoc\b", re.I)
#: Tags of the documentation dialects, with the name that they are about.
_TAG = re.compile(r"^\s*(?:[@:\\](?:param|arg|argument|parameter|tparam|typeparam|property|prop|throws|exception|raises?|template)\b\s*(?:\{[^}]*\}\s*)?(?:\w+\s+(?=\w+:))?[\[\]\w.*$]*\s*(?:=[^\]]*\])?\]?\s*:?|[@:\\](?:returns?|rtype|yields?|type|see|since|author|version|deprecated|public|private|static|async|function|method|override)\b\s*(?:\{[^}]*\}\s*)?:?)\s*[-–]?\s*", re.I)
#: Words that say nothing by themselves.
_FILLERS = frozenset(
    "the a an this that these those is are was be it its of to for and or in on by with from as function functions method methods func fn def procedure routine member helper "
    "implementation class object instance return returns returned returning value values result results param params parameter parameters arg args argument arguments input "
    "inputs output outputs given passed name named called does do int integer str string bool boolean float double number list array dict map any void none null optional raises "
    "der die das ein eine einer funktion methode la el los las un una función método le les une fonction méthode de du des".split()
)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\dA-Za-z_]+")


def _parts(name: str) -> list[str]:
    return [p.lower() for p in _PART.findall(name)]


def _stem(word: str) -> str:
    for end in ("ings", "ing", "ies", "ied", "es", "ed", "s", "er"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)].rstrip("e")
    return word.rstrip("e")


def substance(doc: str, name: str, params: list[str], cls: str = "") -> bool:
    """Whether documentation says something: not empty, a mark of documentation still to be written, or only the names again."""
    said: list[str] = []
    paragraph: list[str] = []
    for line in [*doc.split("\n"), ""]:
        line = line.strip()
        if line:
            paragraph.append(line)
            continue
        if paragraph and not _PLACEHOLDER.match(" ".join(paragraph).strip("*_`#=-~. ")):
            said.extend(x for x in paragraph if not _PLACEHOLDER.match(x.strip("*_`#=-~. ")))
        paragraph = []
    names = {name.lower(), *(_stem(p) for p in _parts(name)), *(p.lower() for p in params), *(_stem(x) for p in params for x in _parts(p)), *(_stem(x) for x in _parts(cls))}
    for line in said:
        tagged = _TAG.match(line)
        rest = line[tagged.end() :] if tagged else line
        head = re.match(r"\s*[-*]?\s*(\w+)\s*(?:\([^)]*\))?\s*:\s*", rest)
        if head and head.group(1).lower() in names:
            rest = rest[head.end() :]
        if _PLACEHOLDER.match(rest.strip(" .*_-")):
            continue
        for w in re.findall(r"[^\W_]\w*|_\w+", _INHERIT.sub(" ", rest)):
            for p in _parts(w) or [w.lower()]:
                if len(p) > 1 and not p.isdigit() and p not in _FILLERS and _stem(p) not in names:
                    return True
    return False


def module_of(path: str) -> str:
    """Dotted path without leading ``./`` and without extension."""
    p = re.sub(r"^(?:\./|/)+", "", path.strip().replace("\\", "/"))
    p = re.sub(r"/+", "/", p)
    head, _, base = p.rpartition("/")
    stem = base.rsplit(".", 1)[0] if "." in base.lstrip(".") else base
    return (f"{head}/{stem}" if head else stem).replace("/", ".")


_SYMBOLS = "file_id long, repository_id long, kind string, module string, cls string, name string, signature string, docstring string, state string, line_start int, bases array<string>"


def _kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SYMBOLS.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 7, pa.int32(), pa.list_(pa.string())]
    for batch in batches:
        rows: list[tuple] = []
        for i, repo, path, lang, text in zip(*(batch.column(c).to_pylist() for c in range(5))):
            known = language_of(path, lang)
            if not known:
                continue
            found = parse(text, known)
            module = module_of(path)
            for f in found.functions:
                if f.doc is None:
                    state = "none"
                elif substance(f.doc, f.name, f.params, f.cls):
                    state = "own"
                else:
                    state = "inherit" if _INHERIT.search(f.doc) else "trivial"
                rows.append((i, repo, "function", module, f.cls, f.name, f.signature, f.doc, state, f.line_start, None))
            for name, bases in found.classes:
                rows.append((i, repo, "class", module, name, name.rsplit(".", 1)[-1], None, None, None, None, bases))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)


def parse_sources(files: DataFrame) -> DataFrame:
    """Functions and classes of source files (file_id, repository_id, file_path, lang, content), one row each.

    ``state`` tells a function's own documentation: own, trivial, inherit (only an inherit tag) or
    none. Rows without id, path or content, and files of other languages, give nothing.
    """
    f = files.select(F.col("file_id").cast("long"), F.col("repository_id").cast("long"), "file_path", "lang", "content")
    f = f.filter("file_id is not null and length(trim(file_path)) > 0 and length(content) > 0")
    return f.mapInArrow(_kernel, _SYMBOLS)


def _base_edges(classes: DataFrame) -> DataFrame:
    """(file_id, cls, pos, to_file, to_cls): the class that each declared base is, in the order of declaration.

    ``classes`` are (scope, folder, module, file_id, cls, simple, bases). Names are looked up in
    tables with one row per name, so a name that many classes share makes no pairs. A name that
    stands for several classes of a folder or repository stands for none.
    """
    asked = classes.select("scope", "folder", "file_id", "cls", F.posexplode("bases").alias("pos", "base")).filter("length(base) > 0")
    asked = asked.select("*", F.element_at(F.split("base", r"\."), -1).alias("last"))
    target = F.struct("module", "file_id", "cls")

    def named(*keys: str) -> DataFrame:
        one = classes.groupBy(*keys, "simple").agg(F.min(target).alias("t"), (F.min(F.struct("module", "cls")) == F.max(F.struct("module", "cls"))).alias("only"))
        return one.filter("only").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("simple").alias("__simple"), "t")

    out = asked
    for level, keys in enumerate((("file_id",), ("scope", "folder"), ("scope",))):
        same = F.col("last") == F.col("__simple")
        for k in keys:
            same = same & (F.col(k) == F.col(f"__{k}"))
        out = out.join(named(*keys), same, "left").withColumnRenamed("t", f"t{level}").drop("__simple", *[f"__{k}" for k in keys])
    out = out.withColumn("t", F.coalesce("t0", "t1", "t2")).filter("t is not null and not (t.file_id = file_id and t.cls = cls)")
    return out.select("file_id", "cls", "pos", F.col("t.file_id").alias("to_file"), F.col("t.cls").alias("to_cls")).distinct()


def documented_functions(files: DataFrame) -> DataFrame:
    """(file_id, qualified_name, signature, docstring, doc_from, depth): functions with documentation worth the name.

    ``depth`` is 0 and ``doc_from`` is ``own`` for a function's own documentation; else they tell how
    many levels up, and in which class, a method of the same name documents it: the nearest base
    first, of several at one level the one declared first. A file delivered twice under one id
    counts once; copies under other ids count. Of several functions of one qualified name in a file
    the first with own documentation stands. Files without a repository resolve within themselves.
    Cycles of classes end, as no class is visited twice for one function. Empty tables give no rows.
    """
    kept = Rounds(files.sparkSession)
    parsed = kept.cut(parse_sources(files).distinct(), keep=99)
    qualified = F.concat_ws(".", F.when(F.length("module") > 0, F.col("module")), F.when(F.length("cls") > 0, F.col("cls")), "name")
    functions = parsed.filter("kind = 'function'").withColumn("qualified_name", qualified)
    said = F.struct("signature", "docstring")
    own = functions.filter("state = 'own'").groupBy("file_id", "qualified_name").agg(F.min_by(said, F.struct("line_start", "signature", "docstring")).alias("f"))
    columns = ["file_id", "qualified_name", "signature", "docstring", "doc_from", "depth", "path", "line_start"]
    resolved = [own.select("file_id", "qualified_name", "f.*", F.lit("own").alias("doc_from"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path"), F.lit(0).alias("line_start"))]

    scope = F.coalesce(F.concat(F.lit("r"), F.col("repository_id").cast("string")), F.concat(F.lit("f"), F.col("file_id").cast("string")))
    classes = parsed.filter("kind = 'class'").select(scope.alias("scope"), F.regexp_extract("module", r"^(.*)\.[^.]*$", 1).alias("folder"), "module", "file_id", "cls", F.col("name").alias("simple"), "bases").distinct()
    edges = kept.cut(_base_edges(classes), keep=99)
    known = functions.filter("state = 'own' and cls <> ''").groupBy(F.col("file_id").alias("kf"), F.col("cls").alias("kc"), F.col("name").alias("km")).agg(F.min_by("docstring", F.struct("line_start", "docstring")).alias("inherited"))
    todo = functions.filter("state <> 'own' and cls <> ''").join(own.select("file_id", "qualified_name"), ["file_id", "qualified_name"], "left_anti")
    todo = todo.select("file_id", "qualified_name", "signature", "name", "line_start", F.col("file_id").alias("at_file"), F.col("cls").alias("at_cls"), F.array().cast("array<int>").alias("path"))
    seen = todo.select("file_id", "qualified_name", "at_file", "at_cls").distinct()
    depth = 0
    while todo is not None:
        depth += 1
        bases = edges.select(F.col("file_id").alias("ef"), F.col("cls").alias("ec"), "pos", "to_file", "to_cls")
        up = todo.join(bases, (F.col("at_file") == F.col("ef")) & (F.col("at_cls") == F.col("ec")))
        up = up.select("file_id", "qualified_name", "signature", "name", "line_start", F.col("to_file").alias("at_file"), F.col("to_cls").alias("at_cls"), F.concat("path", F.array("pos")).alias("path"))
        up = up.join(seen, ["file_id", "qualified_name", "at_file", "at_cls"], "left_anti")
        up = up.groupBy("file_id", "qualified_name", "at_file", "at_cls", "name").agg(F.min(F.struct("path", "line_start", "signature")).alias("s")).select("file_id", "qualified_name", "at_file", "at_cls", "name", "s.*")
        met = kept.cut(up.join(known, (F.col("at_file") == F.col("kf")) & (F.col("at_cls") == F.col("kc")) & (F.col("name") == F.col("km")), "left").drop("kf", "kc", "km"), keep=99)
        if not met.limit(1).count():
            break
        hit = met.filter("inherited is not null").select("file_id", "qualified_name", "signature", F.col("inherited").alias("docstring"), F.col("at_cls").alias("doc_from"), F.lit(depth).alias("depth"), "path", "line_start")
        resolved.append(hit)
        seen = seen.unionByName(met.select(*seen.columns))
        todo = met.filter("inherited is null").join(hit.select("file_id", "qualified_name"), ["file_id", "qualified_name"], "left_anti").drop("inherited")
    every = reduce(DataFrame.unionByName, [r.select(*columns) for r in resolved])
    one = every.groupBy("file_id", "qualified_name").agg(F.min_by(F.struct("signature", "docstring", "doc_from", "depth"), F.struct("depth", "path", "line_start", "signature", "docstring")).alias("f"))
    return kept.done(one.select("file_id", "qualified_name", "f.*"))
