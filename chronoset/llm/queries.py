"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, html_extract, language_id, line_dedup, media, ngram_join, sentence_piece, token_counts, toxicity, warc

QUERIES = {
    "op1_benchmark_decontamination": decontam.op1_benchmark_decontamination,
    "op2_html_extraction": html_extract.op2_html_extraction,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_sentencepiece": sentence_piece.op5_sentencepiece,
    "op6_language_id": language_id.op6_language_id,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_warc": warc.op8_warc,
    "op9_ngram_jaccard_join": ngram_join.op9_ngram_jaccard_join,
    "op10_media_columns": media.op10_media_columns,
}
ORACLES = {"op3_line_dedup": line_dedup.ORACLE_SQL, "op8_warc": warc.ORACLE_SQL}
