"""Tool output, stores, Python symbols, model calls and streams."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyloom.operators import events as ev
from tallyloom.operators import mutations as mu
from tallyloom.operators.model_calls import chain_of, ensemble, generate, script_problem, validated
from tallyloom.operators.python_symbols import parse_python
from tallyloom.sources import stores, tools
from tallyloom.streaming import streams as st

T0 = datetime(2025, 1, 1)


def test_tool_outputs(spark):
    raw = [
        (1, "ruff", json.dumps([{"filename": "a.py", "code": "E501", "message": "long", "location": {"row": 3, "column": 1}, "fix": {"message": "cut"}}, {"filename": "b.py", "code": "ANN001", "location": {"row": 4}}])),
        (2, "bandit", json.dumps({"results": [{"filename": "a.py", "line_number": 7, "test_id": "B101", "issue_text": "assert", "issue_severity": "HIGH"}]})),
        (3, "mypy", 'a.py:5: error: Bad type  [arg-type]\nnoise\n{"file": "b.py", "line": 2, "column": 4, "severity": "note", "message": "m", "code": "x"}\n'),
        (4, "semgrep", json.dumps({"results": [{"path": "c.py", "start": {"line": 9}, "check_id": "r", "extra": {"message": "m", "severity": "INFO", "fix": "f"}}]})),
        (5, "pip-audit", json.dumps({"dependencies": [{"name": "x", "version": "1", "vulns": [{"id": "CVE-1", "fix_versions": ["2", "3"], "description": "d" * 300}]}, {"name": "y", "version": "1", "vulns": []}]})),
        (6, "trivy", json.dumps({"Results": [{"Target": "t", "Vulnerabilities": [{"VulnerabilityID": "CVE-2", "PkgName": "p", "InstalledVersion": "1", "FixedVersion": "2", "Severity": "CRITICAL", "Description": "d"}]}, {"Target": "u", "Vulnerabilities": None}]})),
        (7, "ruff", "not json"), (8, "bandit", ""), (9, "trivy", None), (10, "semgrep", "[]"),
    ]
    rows = {(r.run, r.rule_id): r for r in tools.parse_outputs(spark.createDataFrame(raw, "run int, tool string, output string")).collect()}
    assert len(rows) == 8
    assert rows[1, "E501"].severity == "error" and rows[1, "E501"].fix_suggestion == "cut" and rows[1, "ANN001"].severity == "warning"
    assert rows[2, "B101"].line == 7 and rows[2, "B101"].severity == "error"
    assert rows[3, "arg-type"].message == "Bad type" and rows[3, "x"].column == 4
    assert rows[4, "r"].severity == "note"
    assert rows[5, "CVE-1"].fix_suggestion == "Upgrade to 2, 3" and len(rows[5, "CVE-1"].message) == len("x==1 has known vulnerability: ") + 200
    assert rows[6, "CVE-2"].severity == "error" and rows[6, "CVE-2"].message.startswith("p==1 — d")


def test_history_file(spark, tmp_path):
    p = tmp_path / "h.jsonl"
    p.write_text('{"pr_number": 1, "repo": "r", "title": "t"}\nbroken\n{"pr_number": 2, "repo": "r"}\n')
    h = stores.read_history(spark, str(p))
    assert sorted(r.pr_number for r in h.collect()) == [1, 2]
    out = str(tmp_path / "out")
    stores.write_history(h, out)
    stores.write_history(stores.read_history(spark, out).filter("pr_number = 2"), out)
    assert [r.pr_number for r in stores.read_history(spark, out).collect()] == [2]


def test_key_values_and_cache(spark, tmp_path):
    kv = stores.KeyValues(spark, str(tmp_path / "kv"))
    s = "key string, value string, at timestamp, ttl_seconds long"
    kv.put(spark.createDataFrame([("a", "1", T0, 60), ("b", "1", T0, None)], s))
    kv.put(spark.createDataFrame([("a", "2", T0 + timedelta(seconds=5), 60)], s))
    now = lambda x: F.lit(T0 + timedelta(seconds=x)).cast("timestamp")
    assert {(r.key, r.value) for r in kv.get(now(30)).collect()} == {("a", "2"), ("b", "1")}
    assert {r.key for r in kv.get(now(100)).collect()} == {"b"}
    req = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "x")], "m string, p string").withColumn("k", stores.cache_key(F.col("m"), F.col("p")))
    assert req.select("k").distinct().count() == 3
    cache = req.limit(1).select(F.col("k").alias("key"), F.lit("hi").alias("response"), F.lit(T0).cast("timestamp").alias("at"))
    hit, miss = stores.with_cache(req, cache, "k", now(10))
    assert hit.count() == 1 and miss.count() == 2
    assert stores.with_cache(req, cache, "k", now(4000))[0].count() == 0


def test_validated(spark):
    f = spark.createDataFrame([("a", 0, 0.9), ("a", 1, 0.9), ("a", 2, 0.9), ("a", 3, 0.9), ("b", 0, 0.1), ("c", 0, 0.2), (None, 0, 0.3)], "req string, idx int, confidence double")
    v = spark.createDataFrame([("a", True, 0, True, 0.8), ("a", True, 1, False, 0.9), ("a", True, 2, None, None), ("a", True, 3, True, 0.5), ("a", True, 3, True, 0.65), ("a", True, 9, True, 1.0), ("b", False, None, None, None), (None, True, 0, True, 0.95)], "req string, ok boolean, idx int, is_valid boolean, confidence double")
    got = {(r.req, r.idx): r.confidence for r in validated(f, v, ["req"]).collect()}
    assert got == {("a", 0): 0.8, ("a", 3): 0.65, ("b", 0): 0.7, ("c", 0): 0.7, (None, 0): 0.95}


def test_python_symbols(spark):
    src = "import os\nfrom a.b import c as d\nMAX_SIZE = 1\nclass K(Base):\n    '''Doc.'''\n    async def m(self, x: int = 1) -> int:\n        def inner(): pass\n        return os.path.join(x)\ndef _p(): pass\n"
    f = spark.createDataFrame([("llm/k.py", src), ("bad.py", "def ("), ("n.py", None), (None, src)], "file_path string, content string")
    rows = {r.name: r for r in parse_python(f).collect()}
    assert set(rows) == {"MAX_SIZE", "K", "m", "_p"}
    assert rows["m"].qualified_name == "llm.k.K.m" and rows["m"].kind == "method" and rows["m"].signature == "(self, x: int=1) -> int"
    assert not rows["_p"].is_exported and rows["K"].docstring == "Doc."
    e = {(r.source, r.target, r.kind) for r in parse_python(f, "edges").collect()}
    assert {("llm.k", "os", "import"), ("llm.k", "a.b.c", "import"), ("llm.k.K", "Base", "inherit"), ("llm.k.K.m", "os.path.join", "call")} <= e
    c = [(r.start_line, r.end_line, r.chunk_type, r.symbol_name) for r in parse_python(f.filter("file_path = 'llm/k.py'"), "chunks").collect()]
    assert c == [(1, 3, "module", ""), (4, 8, "class", "K"), (9, 9, "function", "_p")]
    assert parse_python(f.limit(0)).count() == 0


def test_model_calls(spark):
    def flaky(name, prompt):
        if name == "first":
            raise RuntimeError("503 busy" if "x" in prompt else "401 no")
        return f"{name}:{prompt}"

    req = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, prompt string")
    got = {r.id: r for r in generate(req, ["first", "second"], flaky, wait_seconds=0).collect()}
    assert (got[1].model_used, got[1].attempts) == ("second", 4) and (got[2].model_used, got[2].attempts) == ("second", 2)
    assert got[3].response is None and got[3].attempts == 0
    none = generate(req.limit(1), ["first"], flaky, wait_seconds=0).first()
    assert none.response is None and none.error == "503 busy"
    texts = spark.createDataFrame([(1, "x")], "id int, text string")
    staged = ensemble(texts, ["second"], flaky, [("distill", lambda t, b: t), ("reason", lambda t, b: F.concat(t, F.lit("+"), b))], wait_seconds=0).first()
    assert staged.distill_answer == "second:x" and staged.reason_answer == "second:x+second:x"
    reg = spark.createDataFrame([("a", 1, True, False), ("b", 2, True, True), ("c", 0, False, True)], "name string, priority int, available boolean, supports_tools boolean")
    assert [r.name for r in chain_of(reg, F.lit(False), F.lit("b")).collect()] == ["b", "a"]
    assert [r.name for r in chain_of(reg, F.lit(True), F.lit("zz")).collect()] == ["b"]
    s = spark.createDataFrame([("import socket",), ("OS.SYSTEM('x')",), ("print(1)",), ("\n" * 300,), ("import aiohttp",), ("x = EVAL (y)",), ("exec(a)",), ("m = __import__('os')",), ("evaluate(x)",), ("a\n" * 200,)], "s string")
    assert [r.p for r in s.select(script_problem(F.col("s")).alias("p")).collect()] == ["network socket usage", "os.system call", None, "longer than 200 lines", "aiohttp (network) import", "eval() usage (code injection risk)", "exec() usage (code injection risk)", "__import__ usage", None, None]


def drained(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name).collect()


E = "id long, k string, ts timestamp, type string, ok boolean"


def rows_of(seconds, key="a", types=None):
    return [(i, key, T0 + timedelta(seconds=s), (types or {}).get(i, "t"), True) for i, s in enumerate(seconds)]


def test_debounce_batch_and_stream(spark, tmp_path):
    rows = rows_of([0, 30, 59, 60, 100, 125]) + [(50 + i, "b", T0 + timedelta(seconds=s), "t", True) for i, s in enumerate([5, 5, 400])] + [(90, None, T0, "t", True), (91, "a", None, "t", True)]
    df = spark.createDataFrame(rows, E)
    assert sorted(r.id for r in ev.debounce(df, "k", "ts", "id").collect()) == [0, 3, 5, 50, 52]
    df.write.parquet(str(tmp_path / "e"))
    got = drained(st.debounced(spark.readStream.schema(E).parquet(str(tmp_path / "e")), "k", "ts"), "deb")
    assert sorted((r.k, (r.ts - T0).seconds) for r in got) == [("a", 0), ("a", 60), ("a", 125), ("b", 5), ("b", 400)]


def test_debounce_equals_a_loop(spark):
    import random

    rng = random.Random(9)
    rows = [(i, rng.choice("aab"), T0 + timedelta(seconds=rng.randrange(20_000)), "t", True) for i in range(1500)]
    got = {r.id for r in ev.debounce(spark.createDataFrame(rows, E).repartition(5), "k", "ts", "id").collect()}
    want, last = set(), {}
    for i, k, t, *_ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if k not in last or (t - last[k]).total_seconds() >= 60:
            last[k] = t
            want.add(i)
    assert got == want


def test_other_streams(spark, tmp_path):
    rows = rows_of([0, 10, 20, 30], types={0: "connected", 1: "finding", 2: "completed", 3: "late"})
    spark.createDataFrame(rows, E).coalesce(1).write.parquet(str(tmp_path / "e"))
    read = lambda: spark.readStream.schema(E).parquet(str(tmp_path / "e"))
    assert [r.type for r in sorted(drained(st.open_until_terminal(read(), "k", "ts", "type", ("completed", "failed")), "term"), key=lambda r: r.ts)] == ["connected", "finding", "completed"]
    assert sorted(r.granted for r in drained(st.locked(read(), "k", "ts", F.col("type") == "finding", 300), "lock")) == [False, True, True]
    gate = sorted(drained(st.failure_gate(read(), "k", "ts", F.col("type") != "completed"), "gate"), key=lambda r: r.ts)
    assert [(r.failures, r.wait_seconds) for r in gate] == [(1, 120), (2, 300), (0, 0), (1, 120)]
    assert len(drained(st.changed_revisions(read(), "k", "ts", "type"), "rev")) == 4
    assert drained(st.frames(read(), "type", ["id"]), "fr")[0].frame.startswith("event: ")
    seen = []
    q = st.refresh_on_change(read(), lambda b: seen.append(b.count()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert seen == [4]
    import hashlib
    import hmac

    sig = "sha256=" + hmac.new(b"s", b"{}", hashlib.sha256).hexdigest()
    p = spark.createDataFrame([("{}", sig), ("{ }", sig), ("{}", None)], "body string, signature string")
    assert st.signed(p, b"s").count() == 1


def test_versioned_table_and_changes(spark, tmp_path):
    t = mu.VersionedTable(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    t.write(df)
    t.write(mu.upsert(t.read(), spark.createDataFrame([(2, "c"), (3, "d")], "id long, name string"), ["id"], ["name"]))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert t.write(t.read()) == 3 and t.versions() == [2, 3]
    t.drop()
    assert t.versions() == []
    both = mu.insert_absent(df, spark.createDataFrame([(2, "x"), (4, "y"), (4, "z")], "id long, name string"), ["id"])
    assert sorted(map(tuple, both.collect())) == [(1, "a"), (2, "b"), (4, "y")]


def test_changed_files_source(spark, tmp_path):
    from tallyloom.sources.changed_files import ChangedFiles

    (tmp_path / "7.json").write_text(json.dumps([{"filename": "a.py", "patch": "@@", "status": "modified", "additions": 1, "deletions": 0}]))
    spark.dataSource.register(ChangedFiles)
    got = spark.read.format("changed_files").option("path", str(tmp_path)).load().collect()
    assert [(r.pr_number, r.filename) for r in got] == [(7, "a.py")]
