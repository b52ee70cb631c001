"""Logging of the library, under the logger ``fragmatch``."""

from __future__ import annotations

import logging
import sys
from typing import TextIO

FORMAT = "%(asctime)s - %(name)s - %(levelname)s - %(message)s"
NAME = __name__.partition(".")[0]


def setup(level: str = "INFO", format: str = FORMAT, stream: TextIO | None = None) -> logging.Logger:
    """Send the library's messages from ``level`` on to ``stream`` (standard error), in place of what was set up before."""
    logger = logging.getLogger(NAME)
    if not isinstance(getattr(logging, level.upper(), None), int):
        raise ValueError(f"no such level: {level}")
    for old in list(logger.handlers):
        logger.removeHandler(old)
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(logging.Formatter(format))
    logger.addHandler(handler)
    logger.setLevel(level.upper())
    logger.propagate = False
    return logger


def get(name: str) -> logging.Logger:
    """A logger below the library's."""
    return logging.getLogger(f"{NAME}.{name}")
