"""Verification of candidate pairs: robust colour fits and their probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmatch.functions import kernels as K
from fragmatch.functions.exprs import log_bayes_factor
from fragmatch.operators.patches import lists


def fit(pairs: DataFrame, source: str = "src_patch", target: str = "tgt_patch", loss: str = "huber", sigma: float = 0.02, ridge: float = 1e-4) -> DataFrame:
    """``pairs`` with M (9, row-major), b (3), rss, dof, success and probability.

    Patches are flat arrays of RGB pixels. Pairs of different lengths, or with a
    null side, fail: the identity, rss infinite, success false, probability 0.
    """
    names = ("M", "b", "rss", "dof", "success", "probability")
    keep = [c for c in pairs.columns if c not in names]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n = batch.num_rows
                size = lambda c: np.array([len(x) if x.is_valid else -1 for x in batch[c]])
                a, b = size(source), size(target)
                m, bias, rss, ok = np.tile(np.eye(3), (n, 1, 1)), np.zeros((n, 3)), np.full(n, np.inf), np.zeros(n, bool)
                dof = np.maximum(1, np.where(a > 0, a - 12, 1))
                for width in set(a[(a == b) & (a > 0)].tolist()):
                    rows = np.flatnonzero((a == width) & (b == width))
                    take = pa.array(rows)
                    pick = lambda c: batch[c].take(take).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1, 3)
                    m[rows], bias[rows], rss[rows], ok[rows] = K.affine_fit(pick(source), pick(target), loss, sigma, ridge)
                p = np.where(ok, K.chi2_survival(np.where(ok, rss, 0) / sigma**2, dof), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists(m), lists(bias), pa.array(rss), pa.array(dof.astype(np.int32)), pa.array(ok), pa.array(p)], names=[*batch.schema.names, *names])
            whole = batch = None  # or they would be kept while the next batch is read

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keep).schema)
    return pairs.select(*keep).mapInArrow(run, f"{schema}, M array<double>, b array<double>, rss double, dof int, success boolean, probability double")


def accept(fits: DataFrame, min_probability: float = 0.5) -> DataFrame:
    return fits.where(F.col("success") & (F.col("probability") >= min_probability))


def accept_bayes(fits: DataFrame, size: int, sigma: float = 0.02, min_log_bf: float = 0.0, log_p0: str | None = None) -> DataFrame:
    """Fits with ``log_bf`` that is finite and at least ``min_log_bf``."""
    out = fits.withColumn("log_bf", log_bayes_factor(F.when(F.col("success"), F.col("rss")), F.lit(size), sigma, F.col(log_p0) if log_p0 else None))
    return out.where((F.col("log_bf") >= min_log_bf) & (F.col("log_bf") < float("inf")))


def best_match(matches: DataFrame) -> DataFrame:
    """The match of the highest probability; the first by ``match_ord``, then by source image, wins ties."""
    return matches.orderBy(F.desc("probability"), "match_ord", *[c for c in ("src_image",) if c in matches.columns]).limit(1)
