"""The patch index on disk: a log of commits over Parquet folders.

A commit adds a folder of patches, names images whose earlier patches are gone
(replaced, removed or evicted), or both; a compaction writes what is left into one
folder and covers the commits before it. Folders are written first and the commit's
entry last, under the next free number, by a rename that fails if another writer
was sooner. So a reader sees whole commits only, those up to the number it
starts from, whoever writes meanwhile: batch writers and streams take turns.

Descriptors are several times as large as the patches that they are made of. A
commit whose descriptors come from one of ``kernels.PATCHWISE`` keeps that
kernel's name in their place, and readers get them made again, bit by bit the same.
"""

from __future__ import annotations

import json
import threading
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmatch.errors import IndexCorruptedError, TargetExistsError, TargetNotFoundError
from fragmatch.functions import kernels as K
from fragmatch.functions.exprs import md5_shard
from fragmatch.operators import patches
from fragmatch.plans.scratch import save


def with_shard(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with the shard of their image: MD5 of the id modulo ``shards``."""
    return rows.withColumn("shard", md5_shard(F.col("image_id"), shards))


# -- the log -------------------------------------------------------------------------------

LOG = "number long, data string, rows long, shards int, gone string, covers long, compacted boolean, tag string, kernel string"
#: A task writes to at most so many shards' files at once; each holds a row group of so many bytes.
OPEN_FILES, ROW_GROUP = 16, 8 << 20
_FILES = "spark.sql.maxConcurrentOutputFileWriters"
_writing, _before, _turn = {}, {}, threading.Lock()
#: Attempts to find a free number before giving up.
ATTEMPTS = 100


@dataclass(frozen=True)
class Commit:
    """``data`` and ``gone`` name folders; entries up to ``covers`` are out of force; ``tag`` is a writer's own mark, ``kernel`` makes descriptors that ``data`` lacks."""

    number: int
    data: str | None = None
    rows: int = 0
    shards: int | None = None
    gone: str | None = None
    covers: int | None = None
    compacted: bool = False
    tag: str | None = None
    kernel: str | None = None


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    p = _path(spark, path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration())


def history(spark: SparkSession, path: str) -> list[Commit]:
    """All commits that are kept, the first one first; none if nothing is there."""
    if not _files(spark, path).exists(_path(spark, f"{path}/log")):
        return []
    rows = spark.read.schema(LOG).json(f"{path}/log").where("number is not null").orderBy("number").collect()  # one small row for each commit since the last but one compaction
    return [Commit(**r.asDict()) for r in rows]


def in_force(commits: list[Commit], number: int | None = None) -> list[Commit]:
    """The commits that make up the index, or made it up at ``number``."""
    seen = [c for c in commits if number is None or c.number <= number]
    covered = max((c.covers for c in seen if c.covers is not None), default=-1)
    return [c for c in seen if c.number > covered]


def _put(spark: SparkSession, path: str, entry: Commit) -> bool:
    """Write one entry; whether its number was free. The rename is what commits."""
    files = _files(spark, path)
    temporary, final = _path(spark, f"{path}/log/_{uuid.uuid4().hex}"), _path(spark, f"{path}/log/{entry.number:012}.json")
    out = files.create(temporary, False)
    out.write(bytearray(json.dumps(entry.__dict__).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        if files.exists(final):
            return False
        context.rename(temporary, final, options)
        return True
    except Exception:
        if files.exists(final):
            return False
        raise
    finally:
        files.delete(temporary, False)


def _commit(spark: SparkSession, path: str, start: int, everything: bool = False, **fields) -> Commit:
    """Commit under the next free number after ``start``; ``everything`` covers all that comes before it.

    A compaction that another one overtook fails, as it would bring back what that one covers.
    """
    for number in range(start + 1, start + 1 + ATTEMPTS):
        entry = Commit(number, **(fields | ({"covers": number - 1} if everything else {})))
        if _put(spark, path, entry):
            return entry
        if fields.get("compacted") and any(c.covers is not None and c.number > start for c in history(spark, path)):
            raise IndexCorruptedError(f"{path}: compacted by another writer meanwhile; nothing was changed")
    raise RuntimeError(f"{path}: no free number after {ATTEMPTS} attempts")


@contextmanager
def _open_files(spark: SparkSession, files: int):
    """A task writes to so many files side by side; rows of further ones are sorted.

    Of writers that overlap in a session the last one puts back what the first one found.
    """
    own = spark._jsparkSession.sessionUUID()
    with _turn:
        if not _writing.get(own):
            _before[own] = spark.conf.get(_FILES, None)
            spark.conf.set(_FILES, str(files))
        _writing[own] = _writing.get(own, 0) + 1
    try:
        yield
    finally:
        with _turn:
            _writing[own] -= 1
            if not _writing[own]:
                del _writing[own]
                before = _before.pop(own)
                spark.conf.set(_FILES, before) if before is not None else spark.conf.unset(_FILES)


def _folder(rows: DataFrame, path: str, shards: int | None) -> tuple[str, int]:
    """Write patches into a new folder, as they come: sorted by shard they would be held, or spilled, a second time."""
    name = f"f{uuid.uuid4().hex}"
    out = with_shard(rows, shards) if shards else rows
    writer = out.write.partitionBy("shard") if shards else out.write
    with _open_files(rows.sparkSession, OPEN_FILES):
        writer.options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP}).parquet(f"{path}/data/folder={name}")
    return name, rows.sparkSession.read.parquet(f"{path}/data/folder={name}").count()  # from the files' footers


def _gone(ids: DataFrame, path: str) -> str:
    name = f"f{uuid.uuid4().hex}"
    ids.select(F.col("image_id").cast("string").alias("image_id")).distinct().write.parquet(f"{path}/gone/folder={name}")
    return name


def _last(commits: list[Commit]) -> int:
    return max((c.number for c in commits), default=-1)


def _named(kernel) -> str | None:
    """The name under which readers find a kernel; an error if it is none that they could find."""
    if kernel is not None and K.PATCHWISE.get(getattr(kernel, "__name__", None)) is not kernel:
        raise ValueError(f"{kernel} is not among kernels.PATCHWISE: its descriptors must be written")
    return kernel.__name__ if kernel else None


# -- writers -------------------------------------------------------------------------------


def write(rows: DataFrame, path: str, shards: int | None = None, kernel=None) -> None:
    """Make ``rows`` the whole index. What was there before is kept for readers that are under way, until the next time.

    With a ``kernel`` of ``kernels.PATCHWISE`` rows need no descriptors, and none are written: they are what it makes of the patches.
    """
    spark, made = rows.sparkSession, _named(kernel)
    name, n = _folder(rows.drop("descriptor") if made else rows, path, shards)
    _commit(spark, path, _last(history(spark, path)), everything=True, data=name, rows=n, shards=shards, kernel=made)
    vacuum(spark, path)


def add(rows: DataFrame, path: str, replace: bool = True, shards: int | None = None, tag: str | None = None) -> None:
    """Add images; earlier patches of their ids are gone with the same commit, or the images are refused.

    A commit whose ``tag`` the log has already is left out, so that a repeated
    attempt changes nothing. ``shards`` is by default that of the last commit.
    """
    spark = rows.sparkSession
    commits = history(spark, path)
    if tag is not None and any(c.tag == tag for c in commits):
        return
    shards = shards or next((c.shards for c in reversed(commits) if c.data), None)
    name, n = _folder(rows, path, shards)
    ids = spark.read.parquet(f"{path}/data/folder={name}").select("image_id")
    gone = None
    if in_force(commits):
        if not replace and read(spark, path).join(ids.distinct(), "image_id", "left_semi").head(1):
            raise TargetExistsError("a target of that id is indexed already")
        gone = _gone(ids, path)
    _commit(spark, path, _last(commits), data=name, rows=n, shards=shards, gone=gone, tag=tag)


def remove(spark: SparkSession, path: str, ids: list[str] | DataFrame) -> None:
    """Remove images by id; an error if one of a list is not there."""
    if isinstance(ids, list):
        ids = spark.createDataFrame([(i,) for i in ids], "image_id string")
        missing = ids.join(targets(spark, path), "image_id", "left_anti").first()
        if missing:
            raise TargetNotFoundError(missing["image_id"])
    _commit(spark, path, _last(history(spark, path)), gone=_gone(ids, path))


def evict(spark: SparkSession, path: str, max_targets: int) -> None:
    """Remove the images that were added earliest, beyond ``max_targets``; ids decide within one commit."""
    have = targets(spark, path)
    last = have.orderBy(F.desc("seq"), F.desc("image_id")).limit(max_targets)
    old = save(have.join(last, "image_id", "left_anti").select("image_id"))
    if old.head(1):
        remove(spark, path, old)


def compact(spark: SparkSession, path: str) -> None:
    """Write the index as one folder, which covers the commits so far; commits that are made meanwhile stay in force."""
    commits = history(spark, path)
    live = in_force(commits)
    if len(live) < 2:
        return
    last, shards = _last(commits), next((c.shards for c in reversed(live) if c.data), None)
    kernels = {c.kernel for c in live if c.data}
    made = kernels.pop() if len(kernels) == 1 else None
    rows = read(spark, path, last)
    rows = rows.drop("shard") if shards else rows
    name, n = _folder(rows.drop("descriptor") if made else rows, path, shards)
    _commit(spark, path, last, data=name, rows=n, shards=shards, covers=last, compacted=True, kernel=made)
    vacuum(spark, path)


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete what was out of force before the last but one write or compaction: readers of that state are still served."""
    commits = history(spark, path)
    covers = sorted(c.covers for c in commits if c.covers is not None)
    if len(covers) < 2:
        return
    files = _files(spark, path)
    for c in commits:
        if c.number <= covers[-2]:
            for kind, name in (("data", c.data), ("gone", c.gone)):
                if name:
                    files.delete(_path(spark, f"{path}/{kind}/folder={name}"), True)
            files.delete(_path(spark, f"{path}/log/{c.number:012}.json"), False)


# -- readers -------------------------------------------------------------------------------


def _folders(spark: SparkSession, path: str, kind: str, commits: list[Commit]) -> DataFrame:
    """The folders of some commits as one table, each row with its ``folder``."""
    return spark.read.option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/folder={getattr(c, kind)}" for c in commits])


def _numbered(rows: DataFrame, kind: str, commits: list[Commit]) -> DataFrame:
    """``rows`` with ``seq``, the number of the commit that each came with, for its folder."""
    pairs = [F.lit(x) for c in commits for x in (getattr(c, kind), c.number)]
    return rows.withColumn("seq", F.create_map(pairs)[F.col("folder")].cast("long")).drop("folder")


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The index, or its state at a commit, with ``seq``, the commit of each row; an error if there is none or its folders are not whole."""
    live = in_force(history(spark, path), number)
    data = [c for c in live if c.data]
    if not data:
        raise IndexCorruptedError(f"{path}: no index with a commit")
    groups: dict[tuple, list[Commit]] = {}
    for c in data:
        groups.setdefault((c.shards, c.compacted, c.kernel), []).append(c)
    try:
        parts = []
        for (_, compacted, kernel), members in groups.items():
            found = _folders(spark, path, "data", members)
            said, there = sum(c.rows for c in members), found.count()
            if there != said:
                raise IndexCorruptedError(f"{path}: {there} rows, {said} expected")
            found = found.drop("folder") if compacted else _numbered(found, "data", members)
            parts.append(patches.describe(found, K.PATCHWISE[kernel]) if kernel else found)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        ends = [c for c in live if c.gone]
        if ends:
            end = _numbered(_folders(spark, path, "gone", ends), "gone", ends).groupBy(F.col("image_id").alias("_id")).agg(F.max("seq").alias("_end"))
            rows = rows.join(end, F.col("image_id") == F.col("_id"), "left").where(F.col("_end").isNull() | (F.col("seq") >= F.col("_end"))).drop("_id", "_end")
    except AnalysisException as e:
        raise IndexCorruptedError(f"{path}: {e}") from e
    return rows


def targets(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, seq, patches) of the images of the stored index."""
    return read(spark, path).groupBy("image_id").agg(F.max("seq").alias("seq"), F.count("*").alias("patches"))


def shard_info(rows: DataFrame) -> DataFrame:
    """(shard, size), the smallest shard number first."""
    return rows.groupBy("shard").agg(F.count("*").alias("size")).orderBy("shard")


class Catalog:
    """Targets by id over an index DataFrame; every change gives a new lazy DataFrame.

    ``patches`` has ``image_id``; ``seq`` orders ingestion. A target without
    patches is not registered. ``max_targets`` keeps the latest ingested.
    """

    def __init__(self, patches: DataFrame | None = None, max_targets: int | None = None):
        self.patches, self.max_targets = patches, max_targets
        self._seq = 0
        self._steps = 0

    def _stepped(self) -> Catalog:
        """Every 16th change is saved, so that plans don't grow with the number of targets."""
        self._steps += 1
        if self._steps % 16 == 0 and self.patches is not None:
            self.patches = save(self.patches)
        return self

    def targets(self) -> DataFrame:
        """(image_id, seq, patches) of the registered targets."""
        if self.patches is None:
            raise TargetNotFoundError("nothing is indexed")
        return self.patches.groupBy("image_id").agg(F.max("seq").alias("seq"), F.count("*").alias("patches"))

    def has(self, image_id: str) -> bool:
        return self.patches is not None and bool(self.patches.where(F.col("image_id") == image_id).head(1))

    def add(self, patches: DataFrame, replace: bool = True) -> Catalog:
        """With new targets; those of an id that exists are replaced, or refused."""
        self._seq += 1
        new = patches.withColumn("seq", F.lit(self._seq).cast("long"))
        if self.patches is None:
            self.patches = new
        else:
            ids = new.select("image_id").distinct()
            if not replace and self.patches.join(ids, "image_id", "left_semi").head(1):
                raise TargetExistsError("a target of that id is indexed already")
            self.patches = self.patches.join(ids, "image_id", "left_anti").unionByName(new)
        return self.evict()._stepped()

    def evict(self) -> Catalog:
        """Without the targets ingested earliest, beyond ``max_targets``."""
        if self.max_targets is not None and self.patches is not None:
            last = self.targets().orderBy(F.desc("seq"), F.desc("image_id")).limit(self.max_targets)
            self.patches = self.patches.join(last.select("image_id"), "image_id", "left_semi")
        return self

    def remove(self, image_id: str) -> Catalog:
        if not self.has(image_id):
            raise TargetNotFoundError(image_id)
        self.patches = self.patches.where(F.col("image_id") != image_id)
        return self._stepped()

    def get(self, image_id: str) -> dict:
        """The row of ``targets`` of one id."""
        row = None if self.patches is None else self.targets().where(F.col("image_id") == image_id).first()
        if row is None:
            raise TargetNotFoundError(image_id)
        return row.asDict()

    def first(self, n: int = 10) -> list[str]:
        """The ids of the ``n`` targets ingested earliest."""
        return [] if self.patches is None else [r["image_id"] for r in self.targets().orderBy("seq", "image_id").limit(n).collect()]


def live_hits(hits: DataFrame, live: DataFrame) -> DataFrame:
    """Hits whose image is still registered: removed targets may have used up places among the best k."""
    return hits.join(live.select("image_id").distinct(), "image_id", "left_semi")


def write_basis(spark: SparkSession, basis: np.ndarray | None, path: str) -> None:
    """Keep the principal axes that an index was described with, or none, beside it."""
    rows = [] if basis is None else [(k, [float(x) for x in row]) for k, row in enumerate(basis)]
    spark.createDataFrame(rows, "k int, v array<double>").write.mode("overwrite").parquet(f"{path}/basis")


def read_basis(spark: SparkSession, path: str) -> np.ndarray | None:
    """The principal axes that the index at ``path`` was described with; null if none were fitted."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/basis")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    rows = [r["v"] for r in spark.read.parquet(f"{path}/basis").orderBy("k").collect()]  # as many as a raw descriptor has numbers
    return np.array(rows, float) if rows else None
