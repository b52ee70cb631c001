"""Command line: ``python -m fragmatch match|index|search|serve|bench|train|test|version``."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fragmatch import __version__, log
from fragmatch.config import Config
from fragmatch.errors import ConfigError, FragmatchError
from fragmatch.operators import coherence, heatmap, scale
from fragmatch.plans import engine
from fragmatch.plans.scratch import save
from fragmatch.sources import images, index, report


def _session() -> SparkSession:
    return SparkSession.builder.appName("fragmatch").getOrCreate()


def _config(args) -> Config:
    given = {k: v for k, v in vars(args).items() if v is not None and k in Config.__dataclass_fields__}
    return Config(**{**{f: getattr(Config.from_env(), f) for f in Config.__dataclass_fields__}, **given})


def match(args) -> int:
    spark, cfg = _session(), _config(args)
    source, target = images.load(spark, args.source), images.load(spark, args.target)
    result = engine.run(source, target, cfg)
    best = result.best.first()
    found = result.regions if result.regions is None or not args.report else coherence.with_transform(result.regions, result.matches, ["src_image", "image_id"])
    regions = [r.asDict() for r in found.drop("members").collect()] if found is not None else []
    print(f"{result.matches.count()} matches, {len(regions)} regions" + (f", best {best['probability']:.4f} at ({best['tgt_x']}, {best['tgt_y']})" if best else ""))
    if args.heatmap and best:
        size = target.select("image_id", "height", "width")
        row = heatmap.smooth(heatmap.inside(result.heatmap, size), size, cfg.smoothing_sigma).first()
        import numpy as np

        with open(args.heatmap, "wb") as f:
            f.write(report.png(report.hot(np.array(row["heat"]).reshape(row["height"], row["width"]))))
    if args.report:
        sizes = source.select(F.col("image_id").alias("src_image"), "height", "width")
        place = heatmap.localize(engine.coherent(result), sizes, "src_image").first().asDict()
        cue = scale.scale_inconsistency(source).first().asDict()
        s, t = sizes.first(), target.select("height", "width").first()
        doc = report.build(cfg, result.matches.count(), best.asDict() if best else None, regions, result.stats.first().asDict(), {"path": args.source, "height": s["height"], "width": s["width"]}, {"path": args.target, "height": t["height"], "width": t["width"]}, place, cue, args.heatmap)
        report.write(doc, args.report)
    return 0


def build_index(args) -> int:
    spark, cfg = _session(), _config(args)
    good, bad = images.scan(spark, args.directory, args.pattern)
    basis = engine.auto_basis(good, cfg)
    index.write(engine.index(good, cfg, engine.kernel_for(cfg, basis)), args.output, cfg.num_shards if cfg.distributed_enabled else None)
    index.write_basis(spark, basis, args.output)
    for row in bad.toLocalIterator():
        print(f"skipped {row['path']}: {row['reason']}", file=sys.stderr)
    return 0


def search(args) -> int:
    spark, cfg = _session(), _config(args)
    if cfg.scoring_mode == "bayes":
        raise ConfigError("an index holds patches of one size; bayes scoring needs the images: use match")
    result = engine.match(images.load(spark, args.source), index.read(spark, args.index), cfg, engine.kernel_for(cfg, index.read_basis(spark, args.index)))
    from fragmatch.operators.knn import by_image

    for row in by_image(result.matches, "probability", args.top).select("image_id", "tgt_x", "tgt_y", "probability").collect():  # args.top at most
        if not images.exists(spark, row["image_id"]):
            print(f"warning: {row['image_id']} is indexed but gone", file=sys.stderr)
        print(json.dumps(row.asDict()))
    return 0


def bench(args) -> int:
    """Accuracy of the splice detector and of copy-move offsets on generated images."""
    from fragmatch.operators import evaluate

    spark = _session()
    began = time.perf_counter()
    one = evaluate.summary(evaluate.detect(evaluate.generated(spark, args.positives, args.negatives))).first().asDict()
    print(json.dumps(one | {"sec_per_image": (time.perf_counter() - began) / max(1, one["n"])}))
    if args.copy_moves:
        began = time.perf_counter()
        rows = save(evaluate.own_offsets(evaluate.generated_copies(spark, args.copy_moves)))
        each = (time.perf_counter() - began) * 1000 / args.copy_moves  # trials run together: the mean is what is known
        print(json.dumps(heatmap.trial_report(rows.withColumn("latency_ms", F.lit(each))).first().asDict()))
    return 0


def train(args) -> int:
    """Priors of natural patches, from the images of a folder."""
    from fragmatch.operators import patches, priors

    spark = _session()
    good, _ = images.scan(spark, args.directory)
    made = {s: priors.train(patches.explode(good, s).select("image_id", "patch_idx", "patch"), s, anchors=args.anchors, components=args.components) for s in args.sizes}
    priors.write_all(spark, made, args.output)
    return 0


def run_service(args) -> int:
    from fragmatch.service import serve

    serve(_session(), _config(args), args.host, args.port)
    return 0


def self_test(args) -> int:
    """The tests beside the package, if they are there."""
    import pytest

    from fragmatch import __file__ as here

    tests = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(here))), "tests")
    if not os.path.isdir(tests):
        print(f"error: no tests at {tests}", file=sys.stderr)
        return 1
    return int(pytest.main([tests, "-q", *(["-k", args.only] if args.only else [])]))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="fragmatch")
    p.add_argument("--log-level", default="WARNING")
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    for name, kind in (("patch-size", int), ("stride", int), ("entropy-threshold", float), ("k-neighbors", int), ("distance-threshold", float), ("min-probability", float)):
        common.add_argument(f"--{name}", type=kind)
    common.add_argument("--scoring-mode", choices=("chi2", "bayes"))
    common.add_argument("--priors-dir")
    m = sub.add_parser("match", parents=[common])
    m.add_argument("source")
    m.add_argument("target")
    m.add_argument("--heatmap")
    m.add_argument("--report")
    m.set_defaults(run=match)
    i = sub.add_parser("index", parents=[common])
    i.add_argument("directory")
    i.add_argument("output")
    i.add_argument("-p", "--pattern", default="*.jpg,*.jpeg,*.png")
    i.set_defaults(run=build_index)
    s = sub.add_parser("search", parents=[common])
    s.add_argument("source")
    s.add_argument("index")
    s.add_argument("--top", type=int, default=10)
    s.set_defaults(run=search)
    b = sub.add_parser("bench")
    b.add_argument("--positives", type=int, default=40)
    b.add_argument("--negatives", type=int, default=20)
    b.add_argument("--copy-moves", type=int, default=20)
    b.set_defaults(run=bench)
    t = sub.add_parser("train")
    t.add_argument("directory")
    t.add_argument("output")
    t.add_argument("--sizes", type=int, nargs="+", default=[3, 4, 5, 6])
    t.add_argument("--anchors", type=int, default=2000)
    t.add_argument("--components", type=int, default=16)
    t.set_defaults(run=train)
    r = sub.add_parser("serve", parents=[common])
    r.add_argument("--host", default="127.0.0.1")
    r.add_argument("--port", type=int, default=8000)
    r.set_defaults(run=run_service)
    v = sub.add_parser("version")
    v.set_defaults(run=lambda args: print(__version__) or 0)
    x = sub.add_parser("test")
    x.add_argument("--only")
    x.set_defaults(run=self_test)
    args = p.parse_args(argv)
    try:
        log.setup(args.log_level)
    except ValueError as e:
        p.error(str(e))
    try:
        return args.run(args)
    except FragmatchError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
