"""Every registered query outside the training-data subpackage."""

from . import alerting, features, learning, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
