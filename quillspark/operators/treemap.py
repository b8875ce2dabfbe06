"""Squarified treemaps: the tiles of every parent as rectangles inside the parent's own rectangle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.tree import ROOT, top_tiles
from quillspark.sources.storage import scratch_table


def squarify(sizes: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles (x, y, w, h) of sizes in descending order: rows along the shorter side, each row closed before
    a tile that would make its worst aspect ratio worse. Sizes of zero have rectangles without area."""
    total = sum(sizes)
    areas = [s / total * w * h if total > 0 else 0.0 for s in sizes]
    out: list[tuple[float, float, float, float]] = []
    at, n = 0, sum(a > 0 for a in areas)

    def worst(lo: int, hi: int, side: float) -> float:
        row = sum(areas[lo:hi])
        return max(side * side * areas[lo] / (row * row), row * row / (side * side * areas[hi - 1]))

    while at < n and w > 0 and h > 0:
        end, side = at + 1, min(w, h)
        while end < n and worst(at, end, side) >= worst(at, end + 1, side):
            end += 1
        if end == n and end - at == 1:
            out.append((x, y, w, h))
            break
        row, place = sum(areas[at:end]), 0.0
        deep = row / side
        for a in areas[at:end]:
            out.append((x, y + place, deep, a / deep) if w >= h else (x + place, y, a / deep, deep))
            place += a / deep
        x, y, w, h = (x + deep, y, max(w - deep, 0.0), h) if w >= h else (x, y + deep, w, max(h - deep, 0.0))
        at = end
    return out + [(x, y, 0.0, 0.0)] * (len(sizes) - len(out))


def treemap(tree: DataFrame, size: str, width: float = 1.0, height: float = 1.0, levels: int = 3, most: int = 27) -> DataFrame:
    """(page_id, parent_id, level, tile, size, nodes, x, y, w, h): of each page the tiles of the roots (level 1),
    and of each tile's node the tiles below it inside its rectangle, down to `levels` levels.

    size: a column of the tree that is what a node weighs with all below it. A parent has at most `most` tiles and
    one for the rest, so a group is small; rectangles are handed down by one join a level."""
    tiles = scratch_table(top_tiles(tree, size, most).select("page_id", "parent_id", "tile", F.col("size").cast("double").alias("size"), "nodes"))
    frames = tiles.where(F.col("parent_id") == ROOT).select("page_id", "parent_id").distinct()
    frames = frames.select("page_id", "parent_id", *(F.lit(float(v)).alias(c) for c, v in zip(("fx", "fy", "fw", "fh"), (0.0, 0.0, width, height), strict=True)))
    kinds = dict(tiles.dtypes)
    schema = f"page_id {kinds['page_id']}, parent_id {kinds['parent_id']}, tile string, size double, nodes long, x double, y double, w double, h double"

    def lay(group: pd.DataFrame) -> pd.DataFrame:
        rest = group["tile"] == "other"
        group = group.assign(__rest=rest, __id=pd.to_numeric(group["tile"].where(~rest), errors="coerce")).sort_values(["size", "__rest", "__id"], ascending=[False, True, True])
        f = group.iloc[0]
        placed = squarify(group["size"].tolist(), f["fx"], f["fy"], f["fw"], f["fh"])
        return group[["page_id", "parent_id", "tile", "size", "nodes"]].assign(**{c: [r[i] for r in placed] for i, c in enumerate("xywh")})

    out = None
    for level in range(1, levels + 1):
        placed = scratch_table(tiles.join(frames, ["page_id", "parent_id"]).groupBy("page_id", "parent_id").applyInPandas(lay, schema).withColumn("level", F.lit(level)))
        out = placed if out is None else out.unionByName(placed)
        frames = placed.where("tile <> 'other' AND w > 0 AND h > 0").select("page_id", F.col("tile").cast(kinds["parent_id"]).alias("parent_id"), *(F.col(c).alias(f"f{c}") for c in "xywh"))
    return out
