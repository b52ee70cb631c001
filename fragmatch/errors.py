"""Errors raised by this library."""


class FragmatchError(Exception):
    """Root of all errors here."""


class ConfigError(FragmatchError, ValueError):
    """A setting is out of range, or settings contradict each other."""


class ImageError(FragmatchError, ValueError):
    """An image can't be used: unreadable, not RGB, too small or not finite."""


class ImageShapeError(ImageError):
    """An image is not height x width x 3."""


class IndexCorruptedError(FragmatchError):
    """A stored index does not hold what its metadata says."""


class TargetExistsError(FragmatchError):
    """A target of this id is indexed already."""


class TargetNotFoundError(FragmatchError):
    """No target of this id is indexed."""


class MissingDependencyError(FragmatchError):
    """An optional library is needed for this and absent."""
