"""Operators for preparing large text corpora, their queries and the SQL that checks them.

Functions that run in Python workers travel with the task, so executors need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from . import (  # noqa: E402, F401
    chat_format, decontamination, embeddings, hard_negatives, jaccard_join, line_dedup, packing, quality, secret_scans,
    token_alignment, token_counts, toxicity, url_filters,
)
from .registry import LLM_ORACLES, LLM_QUERIES  # noqa: E402, F401
