"""Calls of an external model inside Spark: chain of models, retries, cache split, staged pipeline.

The model is any function (model name, prompt) -> text that raises on failure; it runs in Arrow
batches on the executors. Nothing here knows a provider.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[str, str], str]


def chain_of(models: DataFrame, needs_tools: Column, preferred: Column) -> DataFrame:
    """Available models (name, priority, available, supports_tools) in the order in which to try them: the preferred one first."""
    ok = models.filter(F.col("available") & (~needs_tools | F.col("supports_tools")))
    return ok.withColumn("order", F.when(F.col("name") == preferred, -1).otherwise(F.col("priority"))).orderBy("order", "name")


def generate(requests: DataFrame, chain: list[str], model: Model, tries: int = 3, wait_seconds: float = 1.0, fatal: tuple[str, ...] = ("400", "401", "403", "credit")) -> DataFrame:
    """Requests with ``response``, ``model_used``, ``attempts`` and ``error``: models in order, each up to ``tries`` times with growing waits.

    An error whose text has one of ``fatal`` isn't tried again on that model. If all fail the
    response is null and the last error is kept. A null prompt isn't sent.
    """

    def kernel(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for prompt in b["prompt"]:
                text, used, n, error = None, None, 0, None
                for name in chain if prompt is not None else ():
                    for k in range(tries):
                        n += 1
                        try:
                            text, used, error = model(name, prompt), name, None
                            break
                        except Exception as x:  # noqa: BLE001
                            error = str(x)
                            if any(f in error for f in fatal):
                                break
                            if k + 1 < tries and wait_seconds:
                                time.sleep(wait_seconds * 2**k)
                    if used:
                        break
                out.append((text, used, n, error))
            yield b.assign(**{c: [o[i] for o in out] for i, c in enumerate(("response", "model_used", "attempts", "error"))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInPandas(kernel, f"{fields}, response string, model_used string, attempts int, error string")


def ensemble(requests: DataFrame, chain: list[str], model: Model, stages: list[tuple[str, Callable[[Column, Column], Column]]], **kw: object) -> DataFrame:
    """Stages in a row: each stage's prompt is made from the request's text and the answer before it; columns ``<stage>_answer`` and ``<stage>_ok``."""
    df = requests.withColumn("__before", F.lit(None).cast("string"))
    for name, prompt in stages:
        asked = df.withColumn("prompt", prompt(F.col("text"), F.col("__before")))
        got = generate(asked, chain, model, **kw)  # type: ignore[arg-type]
        df = got.withColumns({f"{name}_answer": F.col("response"), f"{name}_ok": F.col("model_used").isNotNull(), "__before": F.coalesce("response", "__before")}).drop("prompt", "response", "model_used", "attempts", "error")
    return df.drop("__before")


def validated(findings: DataFrame, verdicts: DataFrame, keys: list[str], stage_ok: str = "ok", least: float = 0.6, unchecked: float = 0.7) -> DataFrame:
    """Findings (keys, idx, ...) after the validating stage: those judged valid with at least ``least`` confidence, with the verdict's confidence.

    ``verdicts`` (keys, ``stage_ok``, idx, is_valid, confidence) have one row per judged finding, or
    one with a null idx for a stage that gave none. Where the stage failed or is missing, all
    findings pass with the confidence ``unchecked``. A missing confidence counts as 0.5, a missing
    is_valid as true; of several verdicts on one finding the most confident counts; those on
    findings that don't exist are dropped.
    """
    named = [F.col(k).alias(f"__{k}") for k in keys]
    worked = verdicts.groupBy(*named).agg(F.bool_and(F.coalesce(stage_ok, F.lit(False))).alias("__ok"))
    one = verdicts.filter("idx is not null").groupBy(*named, F.col("idx").alias("__idx")).agg(F.max(F.struct(F.coalesce("confidence", F.lit(0.5)).alias("c"), F.coalesce("is_valid", F.lit(True)).alias("v"))).alias("__r"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    drop = [f"__{k}" for k in keys]
    both = findings.drop("confidence").join(worked, same, "left").drop(*drop)
    both = both.join(one, [*same, F.col("idx") == F.col("__idx")], "left").drop(*drop, "__idx")
    failed = ~F.coalesce("__ok", F.lit(False))
    kept = both.filter(failed | (F.col("__r.v") & (F.col("__r.c") >= least)))
    return kept.withColumn("confidence", F.when(failed, F.lit(unchecked)).otherwise(F.col("__r.c"))).drop("__ok", "__r")


#: What a script to be run may not contain, with the reason.
FORBIDDEN = ((r"\bimport\s+socket\b", "network socket usage"), (r"\bimport\s+subprocess\b", "subprocess usage"), (r"\bos\.system\b", "os.system call"), (r"\bos\.popen\b", "os.popen call"), (r"\bsubprocess\.", "subprocess usage"), (r"\bopen\s*\(.*,\s*['\"]w['\"]", "file write detected"), (r"\bopen\s*\(.*,\s*['\"]a['\"]", "file append detected"), (r"\bimport\s+requests\b", "requests (network) import"), (r"\bimport\s+urllib\b", "urllib (network) import"), (r"\bimport\s+httpx\b", "httpx (network) import"), (r"\bimport\s+aiohttp\b", "aiohttp (network) import"), (r"\beval\s*\(", "eval() usage (code injection risk)"), (r"\bexec\s*\(", "exec() usage (code injection risk)"), (r"__import__\s*\(", "__import__ usage"))


def script_problem(script: Column, max_lines: int = 200) -> Column:
    """The first reason for which a script may not be run, or null."""
    ends = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
    n = F.size(F.split(F.regexp_replace(script, f"(?:{ends})\\z", ""), ends))
    out: Column = F.when((F.length(script) > 0) & (n > max_lines), F.lit(f"longer than {max_lines} lines"))
    for pattern, reason in reversed(FORBIDDEN):
        out = F.when(script.rlike("(?i)" + pattern), F.lit(reason)).otherwise(out)
    return out
