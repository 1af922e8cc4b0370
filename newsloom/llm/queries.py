"""The subpackage's registered queries and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from newsloom.llm.centroids import OP13_SQL, op13_centroids
from newsloom.llm.chat_format import OP2_SQL, op2_chat_format
from newsloom.llm.decontam import OP3_SQL, op3_decontamination
from newsloom.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from newsloom.llm.filter_audit import OP11_SQL, op11_filter_audit
from newsloom.llm.html_extract import op5_html_text
from newsloom.llm.license_scan import op10_license_scan
from newsloom.llm.mixing import OP1_SQL, op1_source_mix
from newsloom.llm.near_dedup import op7_near_dedup
from newsloom.llm.quality_crf import op8_quality_crf
from newsloom.llm.substring_dedup import op4_substring_dedup
from newsloom.llm.token_counts import op9_token_counts
from newsloom.llm.token_files import op12_token_files

QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_chat_format": op2_chat_format,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_text": op5_html_text,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality_crf": op8_quality_crf,
    "op9_token_counts": op9_token_counts,
    "op10_license_scan": op10_license_scan,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_files": op12_token_files,
    "op13_centroids": op13_centroids,
}
ORACLE = {
    "op1_source_mix": OP1_SQL,
    "op2_chat_format": OP2_SQL,
    "op3_decontamination": OP3_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op11_filter_audit": OP11_SQL,
    "op13_centroids": OP13_SQL,
}
