"""The matching engines: lazy plans from rasters to matches, regions and heatmaps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmatch.config import Config
from fragmatch.functions import exprs as X
from fragmatch.functions import kernels as K
from fragmatch.operators import bp, coherence, heatmap, hough, knn, lsh, patches, priors, verify
from fragmatch.plans.scratch import save

#: Settings of the Bayes engine.
BAYES_SIZES = (3, 4, 5, 6)
BAYES_K, BAYES_DISTANCE = 32, 1.5
PEAK_FLOOR, MAX_PEAKS, REACH = 5.0, 32, 4.0
NULL_LABEL = 0.5
SPATIAL_BETA, INCLUSION_BETA = 1.0, 2.0
#: The numbers of at most so many hits are broadcast.
FEW_HITS = 1 << 20


@dataclass
class MatchResult:
    """Lazy results; ``matches`` has ``match_ord``, which orders a source image's matches by patch and rank."""

    matches: DataFrame
    best: DataFrame
    regions: DataFrame | None
    heatmap: DataFrame | None
    stats: DataFrame
    hypotheses: DataFrame | None = None
    posteriors: DataFrame | None = None
    log_z: DataFrame | None = None


@dataclass
class Unindexed:
    """Target images whose patches, cut as ``config`` says, are searched while they are cut; no index of them is made."""

    images: DataFrame
    config: Config

    def near(self, sources: DataFrame, config: Config, kernel=None) -> DataFrame:
        """An index of the patches that a search for the nearest of ``sources`` can find, saved; of all, not saved, where that is not told exactly."""
        exact = not (config.lsh_enabled or self.config.pyramid_enabled or hasattr(kernel, "frame"))
        sift = knn.sift(sources, config.k_neighbors, limit=config.distance_threshold) if exact else None
        if sift is None:
            return index(self.images, self.config, kernel)
        return save(index(dealt(self.images), self.config, kernel, sift).drop("t")).withColumn("t", number("image_id", "level", "patch_idx"))


def dealt(images: DataFrame) -> DataFrame:
    """Images that lie in no more partitions than there are cores, as one file does, in four times as many."""
    cores = images.sparkSession.sparkContext.defaultParallelism
    return images.repartition(4 * cores, "image_id") if images.rdd.getNumPartitions() <= cores else images


def kernel_for(config: Config, basis=None):
    """The descriptor of ``config`` as a batch function."""
    if config.use_learned_descriptors:
        from fragmatch.functions.learned import LearnedDescriptor

        return LearnedDescriptor(config.learned_model)
    dim, pooling = config.descriptor_dim, config.descriptor_pooling
    return lambda p: K.project(K.composite(p, pooling), dim, basis)


def fit_basis(rows: DataFrame, config: Config):
    """Principal axes of at most ``pca_train_samples`` raw descriptors, drawn by hash order; null if there are fewer."""
    s = config.patch_size
    import numpy as np

    sample = priors.sample(rows, config.pca_train_samples).select("patch").toPandas()["patch"]
    if len(sample) < config.pca_train_samples:
        return None
    return K.principal_axes(K.composite(np.stack(sample).reshape(-1, s, s, 3), config.descriptor_pooling), config.descriptor_dim)


def index(images: DataFrame, config: Config, kernel=None, sift=None) -> DataFrame:
    """Patches of all target images with descriptors and an id ``t``; of all pyramid levels if enabled. For ``sift`` see ``described``."""
    s = config.patch_size
    if config.pyramid_enabled:
        rows = patches.pyramid_patches(images, s, config.pyramid_scales, config.stride, config.pyramid_min_size, config.entropy_threshold)
    else:
        rows = described(images, config, kernel, sift).withColumn("level", F.lit(0)).withColumn("scale", F.lit(1.0))
        return rows.withColumn("orig_x", F.col("x")).withColumn("orig_y", F.col("y")).withColumn("t", number("image_id", "level", "patch_idx"))
    return patches.describe(rows.withColumn("t", number("image_id", "level", "patch_idx")), kernel or kernel_for(config), s)


def cut(images: DataFrame, config: Config) -> DataFrame:
    """The rows of ``index`` without descriptors, of images as they are."""
    rows = patches.explode(images, config.patch_size, config.stride, config.entropy_threshold).withColumn("level", F.lit(0)).withColumn("scale", F.lit(1.0))
    return rows.withColumn("orig_x", F.col("x")).withColumn("orig_y", F.col("y")).withColumn("t", number("image_id", "level", "patch_idx"))


def described(images: DataFrame, config: Config, kernel=None, sift=None) -> DataFrame:
    """Patches with descriptors; a kernel that needs whole images (``priors.BayesKernel``) gets the patches as a table.

    With ``sift`` (see ``patches.explode``) those alone that it wants; neither such a kernel nor a pyramid is sifted.
    """
    if hasattr(kernel, "frame"):
        return kernel.frame(save(patches.explode(images, config.patch_size, config.stride, config.entropy_threshold)))
    return patches.explode(images, config.patch_size, config.stride, config.entropy_threshold, kernel or kernel_for(config), sift=sift)


def number(*keys: str) -> F.Column:
    """A 64-bit number for a patch's key: two of 10^9 patches share one with a probability of 3 %."""
    return F.xxhash64(*keys)


def candidates(sources: DataFrame, targets: DataFrame | Unindexed, config: Config, kernel=None, target_ids=None) -> DataFrame:
    """Pairs of source and target patches within the distance threshold, with both patches.

    Descriptors and ids alone go through the search; patches are joined to the hits afterwards.
    ``targets`` is read for the search and again for the patches that were hit: an index that is
    not saved is described twice, and takes no room on disk. Images that are not indexed are cut,
    described and compared with the sources in one pass, and only patches near them leave it.
    """
    s = config.patch_size
    mine = save(described(sources, config, kernel).withColumn("q", number("image_id", "patch_idx")))
    if isinstance(targets, Unindexed):
        targets = targets.near(mine, config, kernel)
    find = lsh.lsh_knn if config.lsh_enabled else knn.knn
    more = {"candidates": config.lsh_candidates, "threshold": config.lsh_threshold} if config.lsh_enabled else {"limit": config.distance_threshold}
    hits = save(knn.within(find(mine, targets, config.k_neighbors, "q", "t", **more), config.distance_threshold))
    left = mine.select("q", F.col("image_id").alias("src_image"), F.col("patch_idx").alias("src_idx"), F.col("x").alias("src_x"), F.col("y").alias("src_y"), F.col("patch").alias("src_patch"))
    right = targets.select("t", "image_id", F.col("patch_idx").alias("tgt_idx"), F.col("orig_x").alias("tgt_x"), F.col("orig_y").alias("tgt_y"), "scale", F.col("patch").alias("tgt_patch"))
    named = hits.select("t").distinct()
    # of the targets, which may be far more than were hit, only those named are exchanged
    right = right.join(F.broadcast(named) if hits.count() <= FEW_HITS else named, "t", "left_semi")
    out = save(hits.join(left, "q")).join(right, "t")
    if target_ids is not None:
        out = knn.of_targets(out, target_ids)
    size = F.when(F.col("scale") == 1.0, F.lit(s)).otherwise(X.effective_size(F.lit(s), F.col("scale")))
    return out.withColumn("patch_size", size).withColumn("match_ord", F.col("src_idx").cast("long") * F.lit(config.k_neighbors + 1) + F.col("rank"))


def coherent(result: MatchResult) -> DataFrame:
    """The matches that belong to coherent regions, or all if there is none."""
    by = ["src_image", "image_id"]
    if result.regions is None or not result.regions.head(1):
        return result.matches
    return coherence.members(result.regions, result.matches, by).drop("cluster")


def run(sources: DataFrame, images: DataFrame, config: Config, kernel=None) -> MatchResult:
    """Match rasters with rasters, in the mode that ``config.scoring_mode`` names.

    In chi-square mode, principal axes are fitted to the targets first if
    ``auto_train_pca`` holds and there are enough patches; the Bayes engine
    takes its priors from ``priors_dir``.
    """
    if config.scoring_mode == "bayes":
        return match_bayes(sources, images, config, priors.read_all(images.sparkSession, config.priors_dir, BAYES_SIZES))
    kernel = kernel or kernel_for(config, auto_basis(images, config))
    return match(sources, save(index(images, config, kernel)), config, kernel)


def auto_basis(images: DataFrame, config: Config):
    """Principal axes of the images' patches, if settings ask for them and patches are enough."""
    if not config.auto_train_pca or config.use_learned_descriptors:
        return None
    return fit_basis(patches.explode(images, config.patch_size, config.stride, config.entropy_threshold).select("image_id", "patch_idx", "patch"), config)


def match(sources: DataFrame, targets: DataFrame | Unindexed, config: Config, kernel=None, target_ids=None) -> MatchResult:
    """Chi-square mode: fit, score, cut, then best match, regions and the best image's heatmap.

    ``sources`` is one query image, or several that are matched as one query.
    ``targets`` is an index, or images without one. Nothing runs before a result is asked for but the
    saving of descriptors and matches.
    """
    pairs = candidates(sources, targets, config, kernel, target_ids)
    fits = verify.accept(verify.fit(pairs, sigma=config.noise_sigma), config.min_probability)
    matches = save(fits.select("src_image", "image_id", "src_idx", "tgt_idx", "src_x", "src_y", "tgt_x", "tgt_y", "patch_size", "rank", "dist", "M", "b", "rss", "probability", "match_ord"))
    best = verify.best_match(matches)
    found = coherence.regions(matches, config.coherence_offset_tolerance, config.coherence_min_cluster, config.min_probability, ["src_image", "image_id"]) if config.coherence_enabled else None
    values = heatmap.pixels(matches.join(best.select("image_id"), "image_id", "left_semi"), config.scale_weights)
    stats = matches.agg(F.count("*").alias("matches"), F.count_distinct("image_id").alias("images"), F.max("probability").alias("best_probability"))
    return MatchResult(matches, best, found, values, stats)


def map_decode(beliefs: DataFrame, nodes: DataFrame, found: DataFrame, backed: DataFrame, labels: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Matches of the nodes whose best label is a peak and not the null label, which is the last.

    A match's target lies at the source plus the peak's offset; its image is
    that of the first candidate that supports the peak.
    """
    chosen = beliefs.where(F.col("map_label") < labels).join(nodes, "node").join(found.select(*by, F.col("peak").alias("map_label"), "dx", "dy"), [*by, "map_label"])
    image = backed.groupBy("node", F.col("peak").alias("map_label")).agg(F.min_by("image_id", "match_ord").alias("image_id"), F.min("match_ord").alias("match_ord"))
    return chosen.join(image, ["node", "map_label"]).select(
        "src_image", "image_id", "src_idx", F.col("x").alias("src_x"), F.col("y").alias("src_y"), (F.col("x") + F.col("dx")).cast("int").alias("tgt_x"), (F.col("y") + F.col("dy")).cast("int").alias("tgt_y"),
        F.col("size").alias("patch_size"), F.element_at("marginal", F.col("map_label") + 1).alias("probability"), "match_ord",
    )


def match_bayes(sources: DataFrame, images: DataFrame, config: Config, prior: dict | None = None, sizes=BAYES_SIZES, k: int = BAYES_K, distance: float = BAYES_DISTANCE, min_log_bf: float = 0.0) -> MatchResult:
    """Bayes mode: log Bayes factors of all sizes vote; peaks become labels of a belief network.

    ``prior`` has a ``Prior`` for some sizes. The last label is the null label.
    Source images are told apart throughout: in ``hypotheses`` peaks are
    numbered from 0 for each.
    """
    from dataclasses import replace

    parts = []
    for s in sizes:
        own = replace(config, patch_size=s, entropy_threshold=None, k_neighbors=k, distance_threshold=distance, lsh_enabled=False, pyramid_enabled=False)
        p = (prior or {}).get(s)
        kernel = priors.BayesKernel(p) if p else K.bayesian
        pairs = candidates(sources, save(index(images, own, kernel)), own, kernel)
        if p:
            density = priors.with_log_density(patches.explode(sources, s, own.stride), p).select(F.col("image_id").alias("src_image"), F.col("patch_idx").alias("src_idx"), "log_p0")
            pairs = pairs.join(density, ["src_image", "src_idx"])
        fits = verify.accept_bayes(verify.fit(pairs, sigma=config.noise_sigma), s, config.noise_sigma, min_log_bf, "log_p0" if p else None)
        parts.append(fits.select("src_image", "image_id", F.lit(s).alias("patch_size"), "src_idx", "src_x", "src_y", "tgt_x", "tgt_y", "rank", "log_bf", "M", "b"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ordinal = F.col("patch_size").cast("long") * F.lit(1 << 40) + F.col("src_idx").cast("long") * F.lit(k + 1) + F.col("rank")
    every = save(every.withColumn("match_ord", ordinal))
    key, by = ["src_image", "patch_size", "src_idx"], ("src_image",)
    nodes = every.groupBy(*key).agg(F.first("src_x").alias("x"), F.first("src_y").alias("y"))
    nodes = save(nodes.withColumn("node", F.monotonically_increasing_id()))
    cands = save(every.join(nodes.select(*key, "node"), key))
    # every source image has offsets, peaks and edges of its own
    found = save(hough.peaks(hough.vote(cands, by), PEAK_FLOOR, MAX_PEAKS, "src_image"))
    labels = (found.agg(F.max("peak")).first()[0] or 0) + 1 if found.head(1) else 0  # at most MAX_PEAKS
    own = found.groupBy("src_image").agg(F.count("*").alias("own"))
    nodes = save(nodes.withColumnRenamed("patch_size", "size").join(own, "src_image", "left").withColumn("own", F.coalesce("own", F.lit(0))))
    backed = save(hough.support(cands, found, REACH, by))
    table = bp.unary_vectors(nodes, backed, labels, NULL_LABEL)
    edges = hough.spatial_edges(nodes, REACH, by).withColumn("beta", F.lit(SPATIAL_BETA)).unionByName(hough.inclusion_edges(nodes, by).withColumn("beta", F.lit(INCLUSION_BETA)))
    beliefs, summary = bp.loopy_bp(table, save(edges), iterations=30, damping=0.4)
    matches = save(map_decode(beliefs, nodes, found, backed, labels, by))
    best = verify.best_match(matches)
    values = heatmap.pixels(matches.join(best.select("image_id"), "image_id", "left_semi"), config.scale_weights)
    stats = matches.agg(F.count("*").alias("matches")).withColumn("peaks", F.lit(found.count()))
    return MatchResult(matches, best, None, values, stats, found, beliefs, summary)
