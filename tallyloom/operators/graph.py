"""The code graph: lookups, bounded breadth-first search, impact, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut

LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def assemble(symbols: DataFrame, order: str = "symbol_id") -> DataFrame:
    """One symbol per qualified name: the last in ``order``."""
    rest = [c for c in symbols.columns if c not in ("qualified_name", order)]
    return symbols.groupBy("qualified_name").agg(F.max(F.struct(order, *rest)).alias("s")).select("qualified_name", "s.*")


def callers(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, caller, line): one row per edge whose source is a known symbol."""
    s = symbols.select(F.col("qualified_name").alias("__q"))
    return edges.join(s, F.col("source") == F.col("__q")).select(F.col("target").alias("name"), F.col("source").alias("caller"), "line")


def callees(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, callee, line): one row per edge whose target is a known symbol."""
    s = symbols.select(F.col("qualified_name").alias("__q"))
    return edges.join(s, F.col("target") == F.col("__q")).select(F.col("source").alias("name"), F.col("target").alias("callee"), "line")


def dependants(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, used_by): files with an edge to a symbol of another file, each pair once."""
    s = symbols.select(F.col("qualified_name").alias("__q"), F.col("file_path").alias("__f"))
    j = edges.join(s, F.col("target") == F.col("__q")).filter(F.col("file_path") != F.col("__f"))
    return j.select(F.col("__f").alias("file_path"), F.col("file_path").alias("used_by")).distinct()


def reach(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, name, depth): what reaches each root along edges within ``depth`` steps, at the least depth, without the root.

    Edges (source, target) are reduced to distinct pairs first; each hop is one join of the newest
    level, minus what was met before, so cycles end.
    """
    e = edges.select("source", "target").distinct()
    seen = roots.select(F.col("name").alias("root"), F.col("name").alias("name"), F.lit(0).alias("depth")).distinct()
    level = seen
    for k in range(1, depth + 1):
        step = level.join(e, level["name"] == e["target"]).select("root", F.col("source").alias("name")).distinct()
        known = seen.select(F.col("root").alias("__r"), F.col("name").alias("__n"))
        level = cut(step.join(known, (F.col("root") == F.col("__r")) & (F.col("name") == F.col("__n")), "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(level)
    return seen.filter("depth > 0")


def level_of(count: Column) -> Column:
    """Bucket of a number of callers: none LOW, from 1 MEDIUM, from 6 HIGH, from 21 CRITICAL."""
    return F.when(count >= 21, "CRITICAL").when(count >= 6, "HIGH").when(count >= 1, "MEDIUM").otherwise("LOW")


def level_rank(level: Column) -> Column:
    """Place of a level in the order of LEVELS, from 0."""
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level) - 1


def impact(edges: DataFrame, symbols: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """Per changed symbol: edges from callers, distinct direct and all callers, files touched, level, and whether an exported symbol with callers changes.

    A symbol that calls itself counts among its direct callers; those within ``depth`` steps leave it out.
    """
    s = symbols.select(F.col("qualified_name").alias("__q"), F.col("file_path").alias("__f"))
    c = changed.select(F.col("qualified_name").alias("name"), "is_exported")
    direct = callers(edges, symbols).join(c.select(F.col("name").alias("__c")), F.col("name") == F.col("__c"))
    per = direct.groupBy("name").agg(F.count("*").alias("n_edges"), F.count_distinct("caller").alias("n_direct"))
    far = reach(edges, c, depth).select(F.col("root").alias("name"), F.col("name").alias("caller"))
    every = direct.select("name", "caller").unionByName(far).distinct().join(s, F.col("caller") == F.col("__q"))
    total = every.groupBy(F.col("name").alias("n2")).agg(F.count("*").alias("n_all"), F.array_sort(F.collect_set("__f")).alias("files"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    j = c.join(per.withColumnRenamed("name", "n1"), F.col("name") == F.col("n1"), "left").join(total, F.col("name") == F.col("n2"), "left")
    return j.select("name", zero("n_edges"), zero("n_direct"), zero("n_all"), F.coalesce("files", F.array().cast("array<string>")).alias("files"), level_of(F.coalesce("n_all", F.lit(0))).alias("level"), (F.col("is_exported") & (F.coalesce("n_direct", F.lit(0)) > 0)).alias("breaking"))


def pairs_to_draw(changed: DataFrame, affected: DataFrame) -> DataFrame:
    """(changed, affected): the drawing edges of a report, each changed file with each affected one of the same report (``report``), not itself.

    Both sides are lists of one report; they meet by an equal key.
    """
    a = affected.select(F.col("report").alias("__r"), F.col("file").alias("affected"))
    return changed.join(a, F.col("report") == F.col("__r")).filter(F.col("file") != F.col("affected")).select("report", F.col("file").alias("changed"), "affected").distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, component): connected components of (id_a, id_b) links; the component is its least id.

    Alternating large-star and small-star steps: minima per node by partial aggregation and one
    equi-join each, O(log^2 n) rounds, whatever the degree of a hub. Nothing is collected but a
    count and a checksum per round. Links that still change after ``rounds`` raise.
    """
    e = edges.select(F.col("id_a").cast("long").alias("u"), F.col("id_b").cast("long").alias("v")).filter("u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")).withColumn("m", F.least("n", "m"))
        large = both.join(low, F.col("u") == F.col("n")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        linked = large.join(small_low, F.col("u") == F.col("n"))
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_low.select(F.col("n").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count("*").alias("c"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now.c, now.s) == mark:
            break
        mark = (now.c, now.s)
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
