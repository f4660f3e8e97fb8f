"""The corpus queries and their SQL, for the entry module to add."""

from __future__ import annotations

from gridspark.llm import decontamination, embedding_dedup, html_extract, line_dedup, mixing, near_dedup, quality, repeat_removal, secret_scan, warc

QUERIES = {
    "op1_quality": quality.op1,
    "op2_secrets": secret_scan.op2,
    "op3_embedding_dedup": embedding_dedup.op3,
    "op4_html_extract": html_extract.op4,
    "op5_warc": warc.op5,
    "op6_decontamination": decontamination.op6,
    "op7_repeat_removal": repeat_removal.op7,
    "op8_mixing": mixing.op8,
    "op9_line_dedup": line_dedup.op9,
    "op10_near_dedup": near_dedup.op10,
}
SQL = {"op3_embedding_dedup": embedding_dedup.OP3_SQL, "op5_warc": warc.OP5_SQL, "op6_decontamination": decontamination.OP6_SQL, "op8_mixing": mixing.OP8_SQL}
