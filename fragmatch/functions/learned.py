"""Descriptors by a pretrained network, if its library is installed."""

from __future__ import annotations

import numpy as np

from fragmatch.errors import MissingDependencyError
from fragmatch.functions.kernels import random_projection, unit


class LearnedDescriptor:
    """Pooled features of an image network, projected to ``dim``; a kernel for ``patches.describe``.

    Patches are scaled to 32 x 32 by repetition. The network is loaded where
    the kernel first runs, once per worker.
    """

    def __init__(self, model: str = "resnet18", dim: int = 256):
        self.model, self.dim, self._net = model, dim, None

    def _load(self):
        try:
            import torch
            import torchvision
        except ImportError:
            raise MissingDependencyError("learned descriptors need torch and torchvision") from None
        net = torchvision.models.get_model(self.model, weights="DEFAULT")
        return torch.nn.Sequential(*list(net.children())[:-1]).eval()

    def __call__(self, patches: np.ndarray) -> np.ndarray:
        if self._net is None:
            self._net = self._load()
        import torch

        at = (np.arange(32) * patches.shape[1]) // 32
        x = patches[:, at][:, :, at].astype(np.float32)
        x = (x - np.array([0.485, 0.456, 0.406], np.float32)) / np.array([0.229, 0.224, 0.225], np.float32)
        with torch.no_grad():
            rows = self._net(torch.from_numpy(np.ascontiguousarray(x.transpose(0, 3, 1, 2)))).flatten(1).numpy().astype(np.float64)
        return unit(rows @ random_projection(rows.shape[1], self.dim))

    def __getstate__(self):
        return {"model": self.model, "dim": self.dim, "_net": None}
