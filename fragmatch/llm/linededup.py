"""Line dedup by site-relative frequency.

A line is boilerplate of a host if more than ``max_ratio`` of the host's pages
hold it. Each page's distinct line hashes are counted per host with map-side
combining; hosts that hold boilerplate get the array of its hashes, which is
joined to the pages once, so that texts are never exploded and put together
again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmatch.llm.arrow import unused
from fragmatch.plans.scratch import save

MAX_RATIO = 0.1
#: A line must be on so many pages of its host, whatever the ratio: on one page alone it is no repetition.
LEAST_PAGES = 2


def _lines(text) -> F.Column:
    return F.split(text, "\n", -1)


def _key(line) -> F.Column:
    """A line's hash, without the white space around it; null for an empty line."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.xxhash64(bare, F.length(bare)))


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, least_pages: int = LEAST_PAGES, contents: bool = False) -> DataFrame:
    """(host, lines): hashes of the lines that exceed the ratio. Null hosts form one host.

    With ``contents``, a host's pages of equal text count as one: copies of a
    page say nothing about its site. Pages then meet as their lines' hashes,
    which are saved.
    """
    keys = F.array_distinct(F.transform(_lines(F.col(text)), _key))
    rows = pages.select(F.col(host).alias("host"), keys.alias("keys"), *([F.xxhash64(text, F.length(text)).alias("content")] if contents else []))
    if contents:
        rows = save(rows.groupBy("host", "content").agg(F.first("keys").alias("keys")))
    total = rows.groupBy("host").agg(F.count("*").alias("pages"))
    lines = rows.select("host", F.explode("keys").alias("line")).where("line is not null")
    seen = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= max(least_pages, 2))
    over = seen.join(total, seen["host"].eqNullSafe(total["host"])).where(F.col("n") > F.col("pages") * F.lit(max_ratio))
    return over.groupBy(seen["host"].alias("host")).agg(F.collect_list("line").alias("lines"))  # at most 1 / max_ratio times a page's mean lines


def drop_boilerplate(
    pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, least_pages: int = LEAST_PAGES, removed: str = "_removed", contents: bool = False
) -> DataFrame:
    """``pages`` with boilerplate lines cut out of ``text``; the last column, ``removed``, counts them.

    A line goes if more than ``max_ratio`` of its host's pages hold it, and at
    least ``least_pages`` do, whatever the host's size. Null texts stay null
    with 0 removed; empty lines stay. Repeated rows count as pages of their
    own, or with ``contents`` as one. A line at exactly the ratio stays. All other columns pass unchanged,
    whatever their names; one named like ``removed`` is replaced.
    """
    keep = [c for c in pages.columns if c != removed]
    found = save(boilerplate(pages, host, text, max_ratio, least_pages, contents))
    # the row goes as one struct, so that no name of its columns can meet another
    rows = pages.select(F.struct(*[pages[c] for c in keep]).alias("row"))
    mine = F.col("row")[text]
    joined = rows.join(found, F.col("row")[host].eqNullSafe(F.col("host")), "left")
    # a page's own boilerplate by a hash set, so that a host with many such lines costs its pages no more
    bad = F.when(F.col("lines").isNotNull(), F.array_intersect(F.transform(_lines(mine), _key), "lines"))
    marked = joined.select("row", F.explode(F.array(bad)).alias("bad"))  # a generator, else it is worked out anew for every line
    some = F.coalesce(F.size("bad"), F.lit(0)) > 0
    kept = marked.select("row", "bad", F.when(some, F.filter(_lines(mine), lambda x: F.coalesce(~F.array_contains("bad", _key(x)), F.lit(True)))).alias("kept"))
    done = kept.select("row", F.when(some, F.array_join("kept", "\n")).otherwise(mine).alias("clean"), F.when(some, F.size(_lines(mine)) - F.size("kept")).otherwise(0).cast("long").alias("n"))
    return done.select(*[F.col("clean").alias(c) if c == text else F.col("row")[c].alias(c) for c in keep], F.col("n").alias(removed))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select("doc_id", "source", F.col("text").alias("clean_text"), F.col("_removed").alias("n_removed"))


OP9_SQL = f"""
WITH line AS (
  SELECT doc_id, source, i, unnest_line AS line, trim(unnest_line, chr(32) || chr(9) || chr(13)) AS bare
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS unnest_line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
), total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source
), over_ratio AS (
  SELECT l.source, l.bare FROM (SELECT source, bare, count(DISTINCT doc_id) AS n FROM line WHERE bare <> '' GROUP BY source, bare) l
  JOIN total t ON l.source IS NOT DISTINCT FROM t.source WHERE l.n > t.pages * CAST({MAX_RATIO} AS DOUBLE) AND l.n >= {LEAST_PAGES}
), marked AS (
  SELECT line.*, o.bare IS NOT NULL AS gone FROM line LEFT JOIN over_ratio o ON line.source IS NOT DISTINCT FROM o.source AND line.bare = o.bare
), back AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS clean_text, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed FROM marked GROUP BY doc_id
)
SELECT d.doc_id, d.source, b.clean_text, coalesce(b.n_removed, 0) AS n_removed FROM documents d LEFT JOIN back b ON d.doc_id = b.doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; what is emptied by that goes.

    Lines must be on three documents of different text: what copies share is no
    boilerplate, and a later stage keeps one of them. Two on a small source are
    most often a document and its near copy, both of which would go before one
    can be chosen.
    """
    count = unused(docs.columns, "removed")
    out = drop_boilerplate(docs, least_pages=3, removed=count, contents=True).where((F.col(count) == 0) | (F.btrim(F.col("text")) != "")).drop(count)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
