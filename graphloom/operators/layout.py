"""Layered layouts of cascade paths, as tables, and an SVG of one."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.storage import materialize

# Colours by hop (the last for all beyond), sizes of nodes, distances.
COLORS = ("#E31A1C", "#FDAE61", "#FFFFBF", "#ABDDA4", "#3288BD", "#8e63b6")
START_SIZE, TARGET_SIZE, FIRST_SIZE, OTHER_SIZE = 3200, 2700, 2500, 2200
STEP_X, STEP_Y = 3.8, 1.7


def path_edges(paths: DataFrame) -> DataFrame:
    """(start, src, dst): the distinct steps of the paths of each start."""
    n = F.size("path")
    pairs = F.arrays_zip(F.slice("path", F.lit(1), n - 1).alias("src"), F.slice("path", F.lit(2), n - 1).alias("dst"))
    return paths.select("start", F.inline(pairs)).distinct()


def distances(steps: DataFrame, max_hops: int = 5) -> DataFrame:
    """(start, node, hop): each node's fewest steps from its start, along steps of any path. One join for each hop, each written, as
    the next one reads it twice."""
    found = materialize(steps.select("start", F.col("start").alias("node")).distinct().withColumn("hop", F.lit(0)), "hop")
    last = found
    for hop in range(1, max_hops + 1):
        reached = last.select("start", F.col("node").alias("src")).join(steps, ["start", "src"]).select("start", F.col("dst").alias("node")).distinct()
        last = materialize(reached.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("hop", F.lit(hop)), "hop")
        found = found.unionByName(last)
    return found


def layers(steps: DataFrame, hops: DataFrame, max_hops: int = 5) -> DataFrame:
    """(start, node, hop, layer_pos): layer 1 by name, later ones by the mean position of their parents in the layer before, then
    by name; those without parents last."""
    w = Window.partitionBy("start")
    before = hops.filter("hop = 0").withColumn("layer_pos", F.lit(0))
    out = before
    for hop in range(1, max_hops + 1):
        mine = hops.filter(F.col("hop") == hop)
        if hop == 1:
            placed = mine.withColumn("layer_pos", F.row_number().over(w.orderBy("node")) - 1)
        else:
            mean = steps.join(before.select("start", F.col("node").alias("src"), "layer_pos"), ["start", "src"]).groupBy("start", F.col("dst").alias("node")).agg(F.avg("layer_pos").alias("mean"))
            placed = mine.join(mean, ["start", "node"], "left").withColumn("layer_pos", F.row_number().over(w.orderBy(F.col("mean").asc_nulls_last(), "node")) - 1).drop("mean")
        placed = materialize(placed.select("start", "node", "hop", "layer_pos"), "layer")
        out, before = out.unionByName(placed), placed
    return out


def positions(paths: DataFrame, max_hops: int = 5) -> DataFrame:
    """layers() with x and y."""
    steps = materialize(path_edges(paths), "steps")
    placed = layers(steps, distances(steps, max_hops), max_hops)
    count = F.count("*").over(Window.partitionBy("start", "hop"))
    return placed.withColumn("x", F.col("hop") * STEP_X).withColumn("y", ((count - 1) / 2 - F.col("layer_pos")) * STEP_Y)


def styled(placed: DataFrame, target: str | None = None) -> DataFrame:
    """placed with color, size and heading."""
    colors = F.array(*map(F.lit, COLORS))
    size = F.when(F.col("node") == F.col("start"), START_SIZE).when(F.col("node") == F.lit(target), TARGET_SIZE).when(F.col("hop") == 1, FIRST_SIZE).otherwise(OTHER_SIZE)
    return placed.withColumn("color", F.get(colors, F.least("hop", F.lit(len(COLORS) - 1)))).withColumn("size", size).withColumn("heading", F.when(F.col("hop") == 0, "Disrupted company").otherwise(F.format_string("%d-hop", "hop")))


def svg(placed: DataFrame, steps: DataFrame, start: str) -> str:
    """A picture of one start's layout; "" if there is nothing to draw. The driver takes only what is drawn."""
    rows = placed.filter(F.col("start") == start).collect()
    lines = steps.filter(F.col("start") == start).collect()
    if not lines:
        return ""
    at = {r["node"]: (80 + r["x"] * 50, -r["y"] * 50) for r in rows}
    top = min(y for _, y in at.values()) - 80
    high = max(y for _, y in at.values()) - top + 80
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 {top:g} {max(x for x, _ in at.values()) + 120:g} {high:g}">']
    out += [f'<line x1="{at[e["src"]][0]:g}" y1="{at[e["src"]][1]:g}" x2="{at[e["dst"]][0]:g}" y2="{at[e["dst"]][1]:g}" stroke="black"/>' for e in lines]
    for r in rows:
        x, y = at[r["node"]]
        out.append(f'<circle cx="{x:g}" cy="{y:g}" r="{r["size"] ** 0.5 / 2:g}" fill="{r["color"]}" stroke="black"/><text x="{x:g}" y="{y:g}" font-size="9" text-anchor="middle">{escape(r["node"])}</text>')
    out += [f'<text x="{80 + hop * STEP_X * 50:g}" y="{top + 30:g}" text-anchor="middle">{heading}</text>' for hop, heading in sorted({(r["hop"], r["heading"]) for r in rows})]
    return "\n".join([*out, "</svg>"])
