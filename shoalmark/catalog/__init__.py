"""All registered queries; importing this package fills the registry."""

from . import community, joining, mixed_models, modelling, pipelines, rows, series, sourcing, spatial, summaries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
