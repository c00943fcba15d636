"""The queries of this subpackage, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chosen_path import OP7_SQL, op7_ngram_jaccard
from .hnsw import op8_hnsw
from .images import op1_image_copies
from .lines import OP10_SQL, op10_line_dedup
from .mixing import op4_mixing
from .quotes import OP9_SQL, op9_quotation_linking
from .tokens import op2_bpe_encoding, op5_token_counts
from .toxicity import op3_toxicity
from .warc import OP6_SQL, op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_image_copies, op2_bpe_encoding, op3_toxicity, op4_mixing, op5_token_counts, op6_warc, op7_ngram_jaccard, op8_hnsw, op9_quotation_linking, op10_line_dedup)
}
ORACLE_SQL: dict[str, str] = {"op6_warc": OP6_SQL, "op7_ngram_jaccard": OP7_SQL, "op9_quotation_linking": OP9_SQL, "op10_line_dedup": OP10_SQL}
