"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op8_bpe
from .cover_tree import OP2_SQL, op2_cover_tree
from .language_id import op1_language_id
from .line_quality import OP9_SQL, op9_line_quality
from .mixing import OP4_SQL, op4_mixing
from .quality_classifier import op3_quality_classifier
from .secret_scan import OP7_SQL, op7_secret_scan
from .simhash import op6_simhash
from .substring_dedup import OP5_SQL, op5_substring_dedup
from .token_store import op10_token_store

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_cover_tree": op2_cover_tree,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_mixing": op4_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash": op6_simhash,
    "op7_secret_scan": op7_secret_scan,
    "op8_bpe": op8_bpe,
    "op9_line_quality": op9_line_quality,
    "op10_token_store": op10_token_store,
}
SQL: dict[str, str] = {
    "op2_cover_tree": OP2_SQL,
    "op4_mixing": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op7_secret_scan": OP7_SQL,
    "op9_line_quality": OP9_SQL,
}
