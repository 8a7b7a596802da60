"""The operators as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import OP3_SQL, op3_decontamination
from .embedding_dedup import op6_embedding_dedup
from .filter_audit import OP11_SQL, op11_filter_audit
from .html_extraction import op8_html_extraction
from .license_scan import OP12_SQL, op12_license_scan
from .mixing import op1_mixing
from .near_dedup import op9_near_dedup
from .quality import op10_quality
from .sharding import op5_sharding
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .token_packing import op2_token_packing
from .toxicity import op7_toxicity
from .whitening import op13_whitening

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_token_packing": op2_token_packing,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_sharding": op5_sharding,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_html_extraction": op8_html_extraction,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality": op10_quality,
    "op11_filter_audit": op11_filter_audit,
    "op12_license_scan": op12_license_scan,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_license_scan": OP12_SQL,
}
