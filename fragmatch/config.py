"""Validated settings, each with an environment variable ``FRAGMATCH_<NAME>``."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from fragmatch.errors import ConfigError

#: Ranges of the numeric settings: (least, most), None where open.
LIMITS: dict[str, tuple] = {
    "patch_size": (3, 16), "stride": (1, None), "entropy_threshold": (0.0, None), "descriptor_dim": (64, 512),
    "k_neighbors": (1, None), "distance_threshold": (0.0, None), "min_probability": (0.0, 1.0), "noise_sigma": (0.0, None),
    "smoothing_sigma": (0.0, None), "pca_train_samples": (100, None), "coherence_offset_tolerance": (0, None),
    "coherence_min_cluster": (2, None), "pyramid_min_size": (3, None), "lsh_threshold": (0.0, 1.0), "lsh_candidates": (1, None),
    "num_shards": (1, None), "max_targets": (1, None),
}


@dataclass
class Config:
    """What a matching engine is told; ``None`` switches a limit off."""

    patch_size: int = 3
    stride: int = 1
    entropy_threshold: float | None = 2.5
    descriptor_dim: int = 256
    descriptor_pooling: bool = True
    k_neighbors: int = 100
    distance_threshold: float = 0.5
    min_probability: float = 0.5
    noise_sigma: float = 0.02
    smoothing_sigma: float = 2.0
    auto_train_pca: bool = True
    pca_train_samples: int = 5000
    coherence_enabled: bool = True
    coherence_offset_tolerance: int = 2
    coherence_min_cluster: int = 3
    scale_weights: dict[int, float] = field(default_factory=lambda: {3: 1.0, 4: 1.2, 5: 1.5, 6: 2.0})
    pyramid_enabled: bool = False
    pyramid_scales: list[float] = field(default_factory=lambda: [1.0, 0.5, 0.25, 0.125])
    pyramid_min_size: int = 16
    lsh_enabled: bool = False
    lsh_threshold: float = 0.3
    lsh_candidates: int = 1000
    use_gpu: bool = False
    use_learned_descriptors: bool = False
    learned_model: str = "resnet18"
    distributed_enabled: bool = False
    num_shards: int = 4
    max_targets: int | None = None
    scoring_mode: str = "chi2"
    aggregation_mode: str = "translation_cluster"
    priors_dir: str | None = None

    def __post_init__(self) -> None:
        for name, (least, most) in LIMITS.items():
            value = getattr(self, name)
            if value is None and name in ("entropy_threshold", "max_targets"):
                continue
            if not isinstance(value, (int, float)) or isinstance(value, bool) or value != value:
                raise ConfigError(f"{name} must be a number, not {value!r}")
            if least is not None and value < least or most is not None and value > most:
                raise ConfigError(f"{name} must be within {least} and {most}, not {value}")
        if self.descriptor_dim < 3 * self.patch_size**2:
            raise ConfigError(f"descriptor_dim must be at least 3 * patch_size ** 2 = {3 * self.patch_size**2}")
        if not self.pyramid_scales or any(s <= 0 for s in self.pyramid_scales) or 1.0 not in self.pyramid_scales:
            raise ConfigError("pyramid_scales must be above 0 and include 1.0")
        if self.distributed_enabled and self.num_shards < 2:
            raise ConfigError("num_shards must be at least 2 if distributed_enabled")
        if self.lsh_enabled and self.k_neighbors > self.lsh_candidates:
            raise ConfigError("k_neighbors must not exceed lsh_candidates")
        if self.use_gpu:
            raise ConfigError("use_gpu is not offered: kernels are numpy's, spread over executors")
        if self.aggregation_mode != "translation_cluster":
            raise ConfigError(f"aggregation_mode must be translation_cluster, not {self.aggregation_mode!r}")
        if self.scoring_mode not in ("chi2", "bayes"):
            raise ConfigError(f"scoring_mode must be chi2 or bayes, not {self.scoring_mode!r}")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        """Settings from ``FRAGMATCH_*`` variables, defaults elsewhere."""
        env = dict(os.environ) if env is None else env
        given: dict = {}
        for f in fields(cls):
            raw = env.get(f"FRAGMATCH_{f.name.upper()}")
            if raw is None:
                continue
            kind = str(f.type)
            try:
                if kind.startswith("bool"):
                    if raw.strip().lower() not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
                        raise ValueError(raw)
                    given[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
                elif kind.startswith("int"):
                    given[f.name] = int(raw)
                elif kind.startswith("float"):
                    given[f.name] = float(raw)
                elif kind.startswith("list"):
                    given[f.name] = [float(x) for x in raw.split(",")]
                elif kind.startswith("str"):
                    given[f.name] = raw
            except ValueError:
                raise ConfigError(f"FRAGMATCH_{f.name.upper()} is not a valid {kind}: {raw!r}") from None
        return cls(**given)
