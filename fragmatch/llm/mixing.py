"""Mixing sources to target weights by capped water-filling.

Every source may give at most ``max_epochs`` times its size. Sources whose
share by weight lies above that are clamped there, and the excess is shared
among the others by weight, until none is above. A source then takes each of its
documents whole as often as its target holds its size, and a seeded sample of
them once more: documents in the order of a hash, the last one in part, so that
the words taken meet the target. Everything is DataFrame code.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fragmatch.llm.arrow import unused
from fragmatch.plans.scratch import drop, save

MAX_EPOCHS = 3
CYCLE = 3
SEED = 12
_SPACE = " \t\n\x0b\f\r"
_INDEX_BITS = 33  # monotonically_increasing_id: partition above, place in it below


def words(text) -> F.Column:
    """The number of runs of characters other than white space; 0 for null. Each run is replaced by one letter, so that no list of words is built."""
    bare = F.regexp_replace(F.btrim(text, F.lit(_SPACE)), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.length(bare), F.lit(0)).cast("long")


def _numbered(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``number``, their place (from 0) in ``order``: dealt by ranges, and counts of the ranges before are added."""
    laid = save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", _INDEX_BITS).alias("part")
    ranges = laid.groupBy(part).agg(F.count("*").alias("n"))  # one row per range
    before = ranges.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.col("at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return laid.select(*rows.columns, "at", part).join(before, "part").select(*rows.columns, (F.col("before") + place).alias("number"))


def fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) with ``target``: shares of the whole by weight, none above ``max_epochs`` times its size.

    A round is one aggregation: what the clamped sources take, and the others'
    weight. Comparisons are exact. Clamped sources stay clamped, and the gap to
    the whole times the weight still free falls to a quarter at least in each
    round, so that rounds grow with the logarithm of sizes and weights (some 60
    for 10^8 sources), not with the number of sources. ``weight`` is an integer
    above 0.
    """
    whole = sources.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    left, free, clamped = Fraction(whole["t"] or 0), whole["w"] or 1, -1
    cap = F.col("source_size") * F.lit(max_epochs)

    def above():
        # cap < left / free * weight, in whole numbers
        return cap.cast("decimal(28,0)") * F.lit(free).cast("decimal(10,0)") < F.lit(int(left)).cast("decimal(28,0)") * F.col("weight").cast("decimal(10,0)")

    while True:
        got = sources.where(above()).agg(F.count("*").alias("n"), F.sum(cap).alias("taken"), F.sum("weight").alias("w")).first()
        if got["n"] == clamped or not got["n"]:
            break
        clamped = got["n"]
        if got["w"] == whole["w"]:
            break  # all are clamped: max_epochs below 1
        left, free = Fraction(whole["t"] - got["taken"]), whole["w"] - got["w"]
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(free))
    return sources.withColumn("target", F.when(above(), cap.cast("double")).otherwise(F.least(share, cap.cast("double"))))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", max_epochs: int = MAX_EPOCHS, cycle: int = CYCLE, seed: int = SEED, weights: DataFrame | None = None) -> DataFrame:
    """(id, source, size, source_size, target, taken) per row of ``docs``.

    ``size`` counts words (0 for null and empty texts). ``weights`` has (source,
    weight) with a row for each source, weight a whole number above 0; without
    it, sources in the order of code points, null last, weigh 1 to ``cycle``,
    repeating. Null is a source like others. A source without words has a target
    of 0. ``taken`` adds up, per source, to its target rounded to a whole
    number, and is at most ``max_epochs`` times a row's size. Rows of one
    source are ordered by the MD5 of seed and id (null: empty), then id and
    size; repeated rows differ in nothing, so that it is the same whichever
    comes first. An empty table gives no row.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), words(F.col(text)).alias("size"))
    sized = save(base.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        weighed = _numbered(sources, F.col("source").asc_nulls_last()).select("source", "source_size", (F.col("number") % cycle + 1).alias("weight"))
    else:
        w = weights.select(F.col("source").alias("of"), "weight")
        weighed = sources.join(w, F.col("source").eqNullSafe(F.col("of"))).select("source", "source_size", F.col("weight").cast("long").alias("weight"))
    weighed = save(weighed)
    targets = fill(weighed, max_epochs).select(F.col("source").alias("of"), "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("goal"))

    # ranges of (source, hash, row): a source with a third of all rows, or rows that are all alike, lie in as many ranges as they need
    order = [F.col("source").asc_nulls_last(), "h", "id", "size", "row"]
    laid = save(sized.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "source", "size", F.monotonically_increasing_id().alias("at")))
    drop(sized)
    part = F.shiftright("at", _INDEX_BITS)
    rows = laid.withColumn("part", part)
    sums = rows.groupBy("part", "source").agg(F.sum("size").alias("n"))
    before = sums.select("part", "source", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long")
    plan = before.join(targets, F.col("source").eqNullSafe(F.col("of")))
    plan = plan.select(F.col("part").alias("p"), F.col("source").alias("s"), "before", "source_size", "target", whole.alias("whole"), (F.col("goal") - whole * F.col("source_size")).alias("rest"))
    run = F.sum("size").over(Window.partitionBy("part", "source").orderBy("at")) - F.col("size")
    joined = rows.withColumn("run", run).join(plan, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("run")))
    return joined.select("id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + more).cast("long").alias("taken"))


def repetitions(mixed: DataFrame) -> DataFrame:
    """Rows of ``mix``, one per repetition: ``epoch`` (from 0) and ``words`` to read, all of a document's or, in its last epoch, the first so many."""
    name = unused(mixed.columns, "epoch")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    out = mixed.where("taken > 0").withColumn(name, F.explode(F.sequence(F.lit(0), times - 1)))
    return out.withColumn(unused(out.columns, "words"), F.least(F.col("size"), F.col("taken") - F.col("size") * F.col(name)))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {CYCLE} + 1 AS w FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source_size / CAST(w AS DOUBLE), source) AS k FROM s
), a AS (  -- what is left, and the weight that is free, if the k - 1 sources of the smallest caps by weight are clamped
  SELECT k, {MAX_EPOCHS} * source_size AS cap, w, CAST(sum(source_size) OVER () - coalesce(sum({MAX_EPOCHS} * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS rest,
    CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS free FROM r
), f AS (SELECT rest, free FROM a WHERE CAST(cap AS HUGEINT) * free >= rest * w ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN CAST({MAX_EPOCHS} * source_size AS HUGEINT) * f.free < f.rest * w THEN CAST({MAX_EPOCHS} * source_size AS DOUBLE) ELSE CAST(f.rest AS DOUBLE) * w / CAST(f.free AS DOUBLE) END AS target FROM r, f
), g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM t
), o AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.goal // g.source_size ELSE 0 END AS whole, g.goal,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS run
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, goal - whole * source_size - run)) AS BIGINT) AS taken FROM o
"""
