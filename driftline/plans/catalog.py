"""All registered queries."""

from . import q_bars, q_indicators, q_io, q_labels, q_models, q_runs, q_trading, q_walk  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
