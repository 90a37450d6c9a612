"""Finding operators against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import findings as fi

SCHEMA = "id long, file_path string, line_start int, message string, confidence double, severity string, extra string"


def greedy(rows, t=0.5):
    kept = []
    for r in sorted(rows, key=lambda r: (-(r[4] or 0.0), r[0])):
        w = set((r[3] or "").lower().split())
        alike = any(k[1] == r[1] and k[2] == r[2] and w and x and len(w & x) / len(w | x) > t for k, x in kept)
        if not alike:
            kept.append((r, w))
    return {k[0] for k, _ in kept}


@pytest.mark.parametrize("heavy", [500, 4])
def test_greedy_dedup(spark, heavy):
    rng = random.Random(heavy)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(3), " ".join(rng.choice("pqrstuvw") for _ in range(rng.randint(0, 6))), rng.choice([None, 0.5, 0.7, 0.9]), "error", "") for i in range(250)]
    rows.append((999, "a", 1, None, 0.9, "note", ""))
    got = {r.id for r in fi.greedy_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), heavy=heavy).collect()}
    assert got == greedy(rows)
    assert fi.greedy_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reference_pair(spark):
    rows = [(1, "test.py", 10, "SQL injection via user input", 0.95, "", ""), (2, "test.py", 10, "SQL injection from user input data", 0.85, "", ""), (3, "test.py", 20, "SQL injection via user input", 0.5, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.id for r in fi.greedy_dedup(df).collect()) == [1, 3]
    o = df.select(fi.word_overlap(F.lit("SQL injection via user input"), F.lit("SQL injection from user input data")).alias("o")).first().o
    assert abs(o - 4 / 7) < 1e-12


def test_prefixes(spark):
    codes = {"E501": "error", "W291": "warning", "ANN001": "warning", "SIM101": "error", "PL001": "note", "UP006": "note", "RUF100": "warning", "": "note"}
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r.c: r.s for r in df.select("c", fi.by_prefix(F.col("c")).alias("s")).collect()} == codes


def test_text_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first().v
    assert val(tx.code_tokens(F.lit("getUserById(userId) HTTPServer x_1 a bC"))) == ["get", "user", "by", "id", "user", "id", "httpserver", "x_1"]
    assert val(tx.norm_path(F.lit(" .\\a\\\\b//./c.py "))) == "a/b/c.py" and val(tx.norm_path(F.lit(" / "))) is None
    assert val(tx.ext(F.lit("a/.bashrc"))) == "" and val(tx.ext(F.lit("a/b.TAR.gz"))) == ".gz"
    assert val(tx.blank(F.lit("​\t "))) and not val(tx.blank(F.lit("x")))
    assert val(tx.module_name(F.lit("./llm/providers/openai_provider.py"))) == "llm.providers.openai_provider"
    import hashlib
    import hmac

    assert val(tx.hmac_sha256_hex(b"secret", F.lit('{"a": "ü"}'))) == hmac.new(b"secret", '{"a": "ü"}'.encode(), hashlib.sha256).hexdigest()
    assert val(tx.hmac_sha256_hex(b"k" * 100, F.lit("x"))) == hmac.new(b"k" * 100, b"x", hashlib.sha256).hexdigest()


def test_suffix_join(spark):
    f = spark.createDataFrame([(1, "src/a.py"), (2, "src/data.py"), (3, "a.py"), (4, None)], "id long, file_path string")
    n = spark.createDataFrame([("a.py",), ("src/data.py",)], "name string")
    assert sorted((r.id, r.name) for r in fi.by_suffix(f, n).collect()) == [(1, "a.py"), (2, "src/data.py"), (3, "a.py")]
    assert len(fi.by_suffix(f, n, contains=True).collect()) == 5  # containment either way


def test_folder_scan(spark, tmp_path):
    from tallyloom.sources.files import language, scan_folder

    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.go").write_text("package b\n")
    (tmp_path / "src" / "bad.py").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "src" / "big.py").write_text("x" * 2000)
    (tmp_path / "src" / "node_modules" / "c.py").write_text("y")
    got = scan_folder(spark, str(tmp_path), (".py", ".go"), max_bytes=1000, globs=["*.go"]).collect()
    assert [(r.file_path, r.content) for r in got] == [("src/a.py", "x = 1\n")]
    only = spark.createDataFrame([("src/b.go",)], "file_path string")
    assert [r.file_path for r in scan_folder(spark, str(tmp_path), only=only).collect()] == ["src/b.go"]
    assert spark.range(1).select(language(F.lit("x/y.TSX")).alias("l")).first().l == "typescript"
