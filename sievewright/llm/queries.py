"""The queries of this subpackage, by the names under which ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from .chat import ORACLE as CHAT_SQL
from .chat import op10_chat_format
from .decontaminate import op1_decontamination
from .extract import op4_html_extraction
from .filter_audit import ORACLE as AUDIT_SQL
from .filter_audit import op13_filter_audit
from .line_dedup import ORACLE as LINES_SQL
from .line_dedup import op3_line_dedup
from .media import op6_media_columns
from .packing import op5_best_fit_packing
from .quality import op2_quality_classifier
from .quality_rules import op11_quality_rules
from .simhash import op8_simhash_dedup
from .substring_dedup import op7_suffix_array_dedup
from .token_counts import op9_token_counts
from .vector_codes import ORACLE as CODES_SQL
from .vector_codes import op12_vector_codes

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_media_columns": op6_media_columns,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_chat_format": op10_chat_format,
    "op11_quality_rules": op11_quality_rules,
    "op12_vector_codes": op12_vector_codes,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {"op3_line_dedup": LINES_SQL, "op10_chat_format": CHAT_SQL, "op12_vector_codes": CODES_SQL, "op13_filter_audit": AUDIT_SQL}
