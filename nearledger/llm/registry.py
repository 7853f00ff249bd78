"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from .decontaminate import OP10_SQL, op10_decontaminate
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .license_scan import op1_license_scan
from .line_dedup import OP7_SQL, op7_line_dedup
from .lm import op9_lm_score
from .packing import op6_packing
from .pii import op5_pii
from .quality import op8_quality
from .simhash import op4_simhash
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_warc": op2_warc,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_lm_score": op9_lm_score,
    "op10_decontaminate": op10_decontaminate,
}
ORACLES = {"op2_warc": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op7_line_dedup": OP7_SQL, "op10_decontaminate": OP10_SQL}
