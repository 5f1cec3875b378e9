"""Schemas of the record sets the workflow exchanges.

Reads declare them: inferred JSON would turn the generation maps into structs, where an
absent key and a null value cannot be told apart and key order is lost.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

_TAGS = "output_core_tag_left STRING, output_core_tag_right STRING"
_MESSAGES = "messages ARRAY<STRUCT<role: STRING, content: STRING>>"
_TEXTS, _SCORES = "MAP<STRING, STRING>", "MAP<STRING, DOUBLE>"

SOURCE = f"task STRING, sample_id STRING, input STRING, output STRING, raw_output STRING, {_TAGS}"
CHAT = (
    f"{_MESSAGES}, task STRING, sample_id STRING, ground_truth STRING, {_TAGS}, "
    f"gold_answer STRING, best_spbleu DOUBLE, best_generation_key STRING, spbleu {_SCORES}"
)
INFERENCE = (
    "task STRING, sample_idx INT, sample_id STRING, input STRING, ground_truth STRING, "
    f"prompt VARIANT, generated {_TEXTS}, extracted_core_answer {_TEXTS}, "
    f"extracted_core_answer_correctness MAP<STRING, BOOLEAN>, extraction_strategy {_TEXTS}, "
    f"caption_score {_SCORES}, {_TAGS}"
)
TRANSLATION_SOURCE = f"{_MESSAGES}, src_lg STRING, trg_lg STRING"
TRANSLATION_REQUEST = "uuid STRING, user_content STRING, gold_answer STRING"
TRANSLATION = (
    "sample_idx INT, sample_id STRING, user_content STRING, gold_answer STRING, prompt VARIANT, "
    f"generated {_TEXTS}, extracted_translation {_TEXTS}, spbleu {_SCORES}, best_spbleu DOUBLE, "
    "best_generation_key STRING, think_tag_valid BOOLEAN"
)
TOKENS = (
    "sample_id STRING, task STRING, output STRING, avg_prob DOUBLE, avg_rank DOUBLE, "
    "avg_top1_hit_rate DOUBLE, n_tokens INT, token_strs ARRAY<STRING>, token_probs ARRAY<DOUBLE>, "
    "token_ranks ARRAY<BIGINT>, token_top1_hits ARRAY<DOUBLE>"
)


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
