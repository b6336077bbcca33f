"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op1_posting_lists
from .chat import OP7_SQL, op7_snapshot_collapse
from .decontam import op2_cgk_decontamination
from .mixing import op9_water_filling
from .quality import op6_additive_quality
from .simhash import op5_pigeonring_simhash
from .substring import OP4_SQL, op4_count_min_substring
from .tokenstore import op3_content_store
from .warc import OP10_SQL, op10_seekable_warc
from .wordpiece import op8_wordpiece_counts

QUERIES = {
    "op1_posting_lists": op1_posting_lists,
    "op2_cgk_decontamination": op2_cgk_decontamination,
    "op3_content_store": op3_content_store,
    "op4_count_min_substring": op4_count_min_substring,
    "op5_pigeonring_simhash": op5_pigeonring_simhash,
    "op6_additive_quality": op6_additive_quality,
    "op7_snapshot_collapse": op7_snapshot_collapse,
    "op8_wordpiece_counts": op8_wordpiece_counts,
    "op9_water_filling": op9_water_filling,
    "op10_seekable_warc": op10_seekable_warc,
}
SQL = {"op4_count_min_substring": OP4_SQL, "op7_snapshot_collapse": OP7_SQL, "op10_seekable_warc": OP10_SQL}
