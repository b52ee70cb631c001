"""A small HTTP service over an engine, by the standard library.

``GET /``, ``/health``, ``/health/live``, ``/health/ready``, ``/config`` and
``/targets``, ``/targets/<id>``; ``POST /index?image_id=..`` and ``/match?target_ids=a,b`` with an
image file as the body; ``DELETE /targets/<id>``.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fragmatch import __version__
from fragmatch.config import Config
from fragmatch.errors import FragmatchError, TargetExistsError, TargetNotFoundError
from fragmatch.operators import heatmap, priors
from fragmatch.plans import engine
from fragmatch.plans.scratch import save, shared_dir
from fragmatch.sources import images, report
from fragmatch.sources.index import Catalog


class Refused(Exception):
    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


class Service:
    """Indexes and matches uploaded images; index changes happen one at a time."""

    def __init__(self, spark: SparkSession, config: Config, kernel=None):
        self.spark, self.config, self.kernel = spark, config, kernel
        self.catalog = Catalog(max_targets=config.max_targets)
        self.lock = threading.Lock()  # held while Spark makes a target's patches
        self.bayes = config.scoring_mode == "bayes"
        self.priors = priors.read_all(spark, config.priors_dir, engine.BAYES_SIZES) if self.bayes else {}
        self.sizes: dict[str, tuple[int, int]] = {}

    def _raster(self, body: bytes, image_id: str):
        if len(body) > images.MAX_BYTES:
            raise Refused(413, "the image is too large")
        head = images.header(body)
        if head is None:
            raise Refused(400, "the image's format is not allowed")
        if head[1] * head[2] > images.MAX_PIXELS:
            raise Refused(413, "the image has too many pixels")
        path = f"{shared_dir(self.spark)}/fragmatch/upload-{uuid.uuid4().hex}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(p)
        out.write(body)
        out.close()
        try:
            raster = save(images.load(self.spark, path).withColumn("image_id", F.lit(image_id)))
        finally:
            files.delete(p, False)
        return raster

    def targets(self) -> list[dict]:
        return [] if self.catalog.patches is None else [r.asDict() for r in self.catalog.targets().orderBy("seq").collect()]

    def index(self, body: bytes, image_id: str) -> dict:
        clean = re.sub(r"[^\w.-]", "", image_id)
        if not clean:
            raise Refused(400, "image_id must not be empty")
        with self.lock:
            if self.catalog.has(clean):
                raise TargetExistsError(clean)
            raster = self._raster(body, clean)
            # the Bayes engine makes patches of several sizes for every match, so that it keeps the images themselves
            rows = raster if self.bayes else save(engine.index(raster, self.config, self.kernel))
            n = rows.count()
            if n:
                self.catalog.add(rows)
                head = images.header(body)
                self.sizes[clean] = head[2], head[1]
        return {"image_id": clean, "patches": n}

    def match(self, body: bytes, target_ids: list[str] | None) -> dict:
        if self.catalog.patches is None:
            raise Refused(503, "nothing is indexed")
        source, targets = self._raster(body, "query"), self.catalog.patches
        if self.bayes:
            chosen = targets if target_ids is None else targets.where(F.col("image_id").isin(target_ids))
            result = engine.match_bayes(source, chosen, self.config, self.priors)
        else:
            result = engine.match(source, targets, self.config, self.kernel, target_ids)
        best = result.best.first()
        regions = result.regions.drop("members").collect() if result.regions is not None else []
        out = {"num_matches": result.matches.count(), "best_match": best.asDict() if best else None, "coherent_regions": [r.asDict() for r in regions], "heatmap": None}
        if best and best["image_id"] in self.sizes:
            size = self.spark.createDataFrame([(best["image_id"], *self.sizes[best["image_id"]])], "image_id string, height int, width int")
            row = heatmap.smooth(heatmap.inside(result.heatmap, size), size, self.config.smoothing_sigma).first()
            out["heatmap"] = report.png_base64(np.array(row["heat"]).reshape(row["height"], row["width"]))
        if self.bayes:
            out["peaks"] = [r.asDict() for r in result.hypotheses.select("peak", "dx", "dy", "weight", "persistence", "votes").orderBy("peak").collect()]  # MAX_PEAKS at most
        return out

    def handle(self, method: str, target: str, body: bytes) -> tuple[int, dict]:
        url = urlsplit(target)
        query = {k: v[0] for k, v in parse_qs(url.query).items()}
        try:
            if method == "GET" and url.path == "/":
                return 200, {"name": "fragmatch", "version": __version__, "first_targets": self.catalog.first(10)}
            if method == "GET" and url.path in ("/health", "/health/live"):
                return 200, {"status": "ok"}
            if method == "GET" and url.path == "/health/ready":
                return (200, {"status": "ready"}) if self.catalog.patches is not None else (503, {"status": "nothing is indexed"})
            if method == "GET" and url.path == "/config":
                return 200, asdict(self.config)
            if method == "GET" and url.path == "/targets":
                return 200, {"targets": self.targets()}
            if method == "GET" and url.path.startswith("/targets/"):
                return 200, self.catalog.get(unquote(url.path.removeprefix("/targets/")))
            if method == "POST" and url.path == "/index":
                return 200, self.index(body, query.get("image_id") or f"img_{len(self.targets()):04d}")
            if method == "POST" and url.path == "/match":
                ids = [x.strip() for x in query.get("target_ids", "").split(",") if x.strip()]
                return 200, self.match(body, ids or None)
            if method == "DELETE" and url.path.startswith("/targets/"):
                with self.lock:
                    self.catalog.remove(unquote(url.path.removeprefix("/targets/")))
                return 200, {"removed": True}
            return 404, {"error": "no such path"}
        except Refused as e:
            return e.status, {"error": str(e)}
        except TargetExistsError as e:
            return 409, {"error": f"{e} is indexed already"}
        except TargetNotFoundError as e:
            return 404, {"error": f"{e} is not indexed"}
        except FragmatchError as e:
            return 400, {"error": str(e)}


def serve(spark: SparkSession, config: Config, host: str = "127.0.0.1", port: int = 8000) -> None:
    service = Service(spark, config)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > images.MAX_BYTES:
                status, doc = 413, {"error": "the image is too large"}
            else:
                status, doc = service.handle(self.command, self.path, self.rfile.read(size))
            raw = json.dumps(doc, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_DELETE = _answer

    ThreadingHTTPServer((host, port), Handler).serve_forever()
