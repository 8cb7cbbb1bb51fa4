"""The graph as tables: edges, risk adjacency, cascade paths and their evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.lexicon import RISK_DIRECTIONS
from graphloom.sources.storage import materialize

_FORWARD = [r for r, d in RISK_DIRECTIONS.items() if d == "forward"]
_REVERSE = [r for r, d in RISK_DIRECTIONS.items() if d == "reverse"]


def edges(triples: DataFrame) -> DataFrame:
    """The edges of ordered triples (edge_ord): none with an empty part, no self-loops, parallel edges stay."""
    full = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("head", "tail", "relation")]
    good = triples.filter(full[0] & full[1] & full[2] & (F.col("head") != F.col("tail")))
    return good.select(F.col("head").alias("src"), F.col("tail").alias("dst"), "relation", "confidence", "source_file", "source_sentence", "edge_ord")


def nodes(edge_table: DataFrame) -> DataFrame:
    """name and node_ord: the first place in which the edges name it, heads before tails."""
    ends = edge_table.select(F.col("src").alias("name"), F.struct("edge_ord", F.lit(0).alias("side")).alias("node_ord")).unionAll(edge_table.select("dst", F.struct("edge_ord", F.lit(1).alias("side"))))
    return ends.groupBy("name").agg(F.min("node_ord").alias("node_ord"))


def counts(edge_table: DataFrame) -> DataFrame:
    """One row: edges and nodes."""
    ends = edge_table.select(F.posexplode(F.array("src", "dst")).alias("side", "name"))
    return ends.agg(F.count_if(F.col("side") == 0).alias("edges"), F.countDistinct("name").alias("nodes"))


def risk_evidence(edge_table: DataFrame) -> DataFrame:
    """Each edge that carries risk, from disrupted to impacted: forward ones before reverse ones."""
    fields = "relation", "confidence", "source_file", "source_sentence", "edge_ord"
    ahead = edge_table.filter(F.col("relation").isin(*_FORWARD)).select(F.col("src").alias("disrupted"), F.col("dst").alias("impacted"), F.col("src").alias("head"), F.col("dst").alias("tail"), *fields, F.lit("forward").alias("traversal_direction"))
    back = edge_table.filter(F.col("relation").isin(*_REVERSE)).select(F.col("dst").alias("disrupted"), F.col("src").alias("impacted"), F.col("src").alias("head"), F.col("dst").alias("tail"), *fields, F.lit("reverse").alias("traversal_direction"))
    return ahead.unionAll(back)


def risk_adjacency(edge_table: DataFrame) -> DataFrame:
    return risk_evidence(edge_table).select("disrupted", "impacted").distinct()


def neighbors(edge_table: DataFrame, company: str) -> DataFrame:
    return risk_adjacency(edge_table).filter(F.col("disrupted") == company).select("impacted").orderBy("impacted")


def cascade_paths(edge_table: DataFrame, start: str | DataFrame | None = None, max_hops: int = 5, limit: int | None = None) -> DataFrame:
    """start, path and hops of all simple paths of 1 to max_hops hops along risk, from one start (which must be a node), from
    those in a table's column start, or from all nodes. With a limit, of each start the first `limit` by hops, then names.

    Each hop is a join of the paths so far with the adjacency, written to the shared folder. Paths are ordered by hops first, so a
    start that has its limit goes no further: with a limit, what one hop starts from never exceeds `limit` paths of a start.
    """
    if max_hops < 0:
        raise ValueError("max_hops is negative")
    spark = edge_table.sparkSession
    if isinstance(start, str):
        if nodes(edge_table).filter(F.col("name") == start).isEmpty():
            raise ValueError(f"{start!r} is not in the graph")
        first = spark.range(1).select(F.lit(start).alias("start"))
    else:
        first = start.select("start").distinct() if start is not None else nodes(edge_table).select(F.col("name").alias("start"))
    risk = materialize(risk_adjacency(edge_table), "risk")
    at = first.filter(F.col("start").isNotNull()).select("start", F.array("start").alias("path"), F.lit(0).cast("long").alias("had"))
    levels = []
    for hop in range(1, max_hops + 1):
        step = at.join(risk, F.element_at("path", -1) == F.col("disrupted")).filter(~F.array_contains("path", F.col("impacted")))
        step = step.select("start", F.concat("path", F.array("impacted")).alias("path"), "had")
        if limit is not None:
            place = F.row_number().over(Window.partitionBy("start").orderBy("path"))
            step = step.withColumn("place", place).filter(F.col("place") <= limit).filter(F.col("had") + F.col("place") <= limit)
        made = materialize(step, "cascade")
        levels.append(made.select("start", "path", F.lit(hop).alias("hops")))
        if limit is None:
            at = made.select("start", "path", "had")
        else:
            full = made.groupBy("start").agg((F.max("had") + F.max("place")).alias("now")).filter(F.col("now") < limit)
            at = made.join(full, "start").select("start", "path", F.col("now").cast("long").alias("had"))
    if not levels:
        return spark.createDataFrame([], "start string, path array<string>, hops int")
    return reduce(DataFrame.unionAll, levels)


def distances_to(risk: DataFrame, targets: DataFrame, max_hops: int) -> DataFrame:
    """target, node and distance: how many hops along risk (disrupted, impacted) from a node to each target (target) at least, up to
    max_hops. Each hop goes backward from the nodes that the last one found."""
    seen = materialize(targets.filter(F.col("target").isNotNull()).select("target", F.col("target").alias("node"), F.lit(0).alias("distance")).distinct(), "distances")
    levels = [seen]
    for hop in range(1, max_hops + 1):
        before = levels[-1].select("target", F.col("node").alias("impacted")).join(risk, "impacted").select("target", F.col("disrupted").alias("node")).distinct()
        new = before.join(reduce(DataFrame.unionAll, levels).select("target", "node"), ["target", "node"], "left_anti")
        levels.append(materialize(new.withColumn("distance", F.lit(hop)), "distances"))
        if levels[-1].isEmpty():
            break
    return reduce(DataFrame.unionAll, levels)


def paths_to(edge_table: DataFrame, pairs: DataFrame, max_hops: int = 5, limit: int | None = None) -> DataFrame:
    """start, target, path and hops of all simple paths of 1 to max_hops hops along risk from a start to its target (pairs: start,
    target); with a limit, of each pair the first `limit` by hops, then names.

    Nodes are labelled with their distance to a target first; a path goes on only to nodes from which its target can still be
    reached in the hops that are left, and a pair that has its limit goes no further.
    """
    if max_hops < 0:
        raise ValueError("max_hops is negative")
    wanted = materialize(pairs.select("start", "target").filter("start IS NOT NULL AND target IS NOT NULL AND start <> target").distinct(), "pairs")
    risk = materialize(risk_adjacency(edge_table), "risk")
    labels = materialize(distances_to(risk, wanted.select("target"), max_hops), "labels").select("target", F.col("node").alias("impacted"), "distance")
    at = wanted.select("start", "target", F.array("start").alias("path"), F.lit(0).cast("long").alias("had"))
    levels = []
    for hop in range(1, max_hops + 1):
        step = at.join(risk, F.element_at("path", -1) == F.col("disrupted")).filter(~F.array_contains("path", F.col("impacted")))
        step = step.join(labels, ["target", "impacted"]).filter(F.col("distance") <= max_hops - hop)
        made = materialize(step.select("start", "target", F.concat("path", F.array("impacted")).alias("path"), "had"), "paths-to")
        there = F.element_at("path", -1) == F.col("target")
        done = made.filter(there)
        if limit is not None:
            place = F.row_number().over(Window.partitionBy("start", "target").orderBy("path"))
            done = done.withColumn("place", place).filter(F.col("had") + F.col("place") <= limit)
        done = materialize(done, "paths-done")
        levels.append(done.select("start", "target", "path", F.lit(hop).alias("hops")))
        at = made.filter(~there)
        if limit is not None:
            found = done.groupBy("start", "target").agg(F.count("*").alias("more"))
            at = at.join(found, ["start", "target"], "left").withColumn("had", F.col("had") + F.coalesce("more", F.lit(0))).filter(F.col("had") < limit).drop("more")
    if not levels:
        return edge_table.sparkSession.createDataFrame([], "start string, target string, path array<string>, hops int")
    return reduce(DataFrame.unionAll, levels)


def first_paths(paths: DataFrame, limit: int) -> DataFrame:
    """The first `limit` paths of each start by hops, then names; rank counts from 1."""
    w = Window.partitionBy("start").orderBy("hops", "path")
    return paths.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def path_evidence(paths: DataFrame, edge_table: DataFrame) -> DataFrame:
    """paths with relationships: all evidence of each hop, forward before reverse, parallel edges in order."""
    n = F.size("path")
    hops = paths.select("start", "path", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), n - 1).alias("a"), F.slice("path", F.lit(2), n - 1).alias("b"))).alias("hop", "pair"))
    found = hops.select("start", "path", "hop", F.col("pair.a").alias("disrupted"), F.col("pair.b").alias("impacted")).join(risk_evidence(edge_table), ["disrupted", "impacted"])
    record = F.struct("hop", "traversal_direction", "edge_ord", "head", "relation", "tail", "confidence", "source_file", "source_sentence")
    rows = found.groupBy("start", "path").agg(F.array_sort(F.collect_list(record)).alias("rows"))
    keep = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("head", "relation", "tail", "confidence", "source_file", "source_sentence", "traversal_direction")]))
    return paths.join(rows.select("start", "path", keep.alias("relationships")), ["start", "path"], "left")


def retrieve_evidence(edge_table: DataFrame, start: str | DataFrame, max_hops: int = 2, max_paths: int = 10) -> DataFrame:
    """Evidence of the first max_paths paths from each start. Filters on the target come after this limit."""
    return path_evidence(first_paths(cascade_paths(edge_table, start, max_hops, max_paths), max_paths), edge_table)


def to_target(evidence: DataFrame, target) -> DataFrame:
    return evidence.filter(F.element_at("path", -1) == target)


def find_path(evidence: DataFrame, names: list[str]) -> DataFrame:
    """The evidence of exactly this path; an error if it isn't there."""
    found = evidence.filter(F.col("path") == F.array(*map(F.lit, names)))
    if found.isEmpty():
        raise ValueError(f"Path not found: {' -> '.join(names)}")
    return found


def path_text(path) -> object:
    return F.array_join(path, " -> ")


def sample_edges(edge_table: DataFrame, limit: int = 5) -> DataFrame:
    return edge_table.orderBy("edge_ord").limit(limit).select(F.format_string("%s --%s--> %s", "src", "relation", "dst").alias("edge"))
