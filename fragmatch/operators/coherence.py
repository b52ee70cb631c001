"""Spatially coherent regions: matches whose offsets fall into touching cells.

Matches are grouped by cell with ordinary aggregation. Occupied cells are far
fewer than matches; their connected components come from the distributed
edge list of touching cells, so nothing is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmatch.operators.components import components
from fragmatch.plans.scratch import save


def offset_cells(matches: DataFrame, tolerance: int = 2) -> DataFrame:
    """``matches`` with ``dx, dy`` and the cell (cx, cy), by floor division also below zero."""
    tol = max(1, tolerance)
    out = matches.withColumn("dx", F.col("tgt_x") - F.col("src_x")).withColumn("dy", F.col("tgt_y") - F.col("src_y"))
    return out.withColumn("cx", F.floor(F.col("dx") / F.lit(tol)).cast("int")).withColumn("cy", F.floor(F.col("dy") / F.lit(tol)).cast("int"))


def clusters(matches: DataFrame, tolerance: int = 2, by: list[str] | None = None) -> DataFrame:
    """``matches`` with ``cluster``: the smallest cell number of its 8-connected component of cells.

    ``by`` names columns within which to cluster, by default the image; an
    empty list lets clusters span images.
    """
    by = ["image_id"] if by is None else by
    cells = offset_cells(matches, tolerance)
    keys = [*by, "cx", "cy"]
    numbered = save(cells.select(*keys).distinct().withColumn("cell", F.xxhash64(*keys)))
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 1), (1, -1), (1, 0), (1, 1))])
    here = numbered.select(*by, F.col("cell").alias("a"), "cx", "cy", F.explode(steps).alias("s")).select(*by, "a", (F.col("cx") + F.col("s.x")).alias("cx"), (F.col("cy") + F.col("s.y")).alias("cy"))
    edges = here.join(numbered.select(*keys, F.col("cell").alias("b")), keys).select("a", "b")
    comp = components(edges)
    named = numbered.join(comp, numbered["cell"] == comp["node"], "left").select(*keys, F.coalesce("component", "cell").alias("cluster"))
    return cells.join(named, keys)


def regions(matches: DataFrame, tolerance: int = 2, min_cluster: int = 3, min_probability: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """One row per coherent region, the most confident first.

    A region has at least ``min_cluster`` matches with a mean probability of at
    least ``min_probability``. Its offset is the corner of its first match's
    cell, its boxes (x, y, w, h) are widened by the first match's patch size,
    its confidence is mean probability x log2(matches + 1). Too few matches
    give no region. ``match_ord`` must be unique and gives what comes first.
    """
    by = ["image_id"] if by is None else by
    tol = max(1, tolerance)
    first = lambda c: F.min_by(c, "match_ord")
    grouped = clusters(matches, tolerance, by).groupBy(*by, "cluster").agg(
        F.count("*").alias("n"), F.avg("probability").alias("mean_probability"), (first("cx") * tol).alias("offset_x"), (first("cy") * tol).alias("offset_y"),
        first("patch_size").alias("size"), *[f(c).alias(f"{n}_{c}") for c in ("src_x", "src_y", "tgt_x", "tgt_y") for n, f in (("lo", F.min), ("hi", F.max))],
        F.sort_array(F.collect_list("match_ord")).alias("members"),
    )
    box = lambda s: F.array(F.col(f"lo_{s}_x"), F.col(f"lo_{s}_y"), F.col(f"hi_{s}_x") - F.col(f"lo_{s}_x") + F.col("size"), F.col(f"hi_{s}_y") - F.col(f"lo_{s}_y") + F.col("size"))
    kept = grouped.where((F.col("n") >= min_cluster) & (F.col("mean_probability") >= min_probability))
    out = kept.select(*by, "cluster", "offset_x", "offset_y", "n", "mean_probability", (F.col("mean_probability") * F.log2(F.col("n") + 1)).alias("confidence"), box("src").alias("source_bbox"), box("tgt").alias("target_bbox"), "members")
    return out.orderBy(F.desc("confidence"), "cluster")


def median_transform(members: DataFrame, region: str = "cluster") -> DataFrame:
    """Elementwise median of the members' colour transforms: (region, M, b)."""
    both = members.select(region, F.posexplode(F.concat("M", "b")).alias("pos", "v"))
    mid = both.groupBy(region, "pos").agg(F.percentile("v", F.lit(0.5)).alias("v"))
    rows = mid.groupBy(region).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("all"))
    return rows.select(region, F.slice("all", 1, 9).alias("M"), F.slice("all", 10, 3).alias("b"))


def members(found: DataFrame, matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``matches`` that belong to a region of ``found``, with its ``cluster``."""
    by = ["image_id"] if by is None else by
    return matches.join(found.select(*by, "cluster", F.explode("members").alias("match_ord")), [*by, "match_ord"])


def with_transform(found: DataFrame, matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Regions with the median colour transform (M, b) of their members."""
    return found.join(median_transform(members(found, matches, by)), "cluster", "left").orderBy(F.desc("confidence"), "cluster")
