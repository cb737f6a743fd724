"""Schemas of the pipeline's tables."""

from __future__ import annotations

PROMPTS = (
    "prompt_id string, question_text string, prompt_text string, negative_prompt_text string, category string, target_word string, "
    "target_word_normalized string, prompt_style_id string, source_trace string, validation_json_ref string, p0 double, p1 double, "
    "p0_bin string, v_score int, p_sem double, s_score double"
)
CANDIDATES = "category string, question_text string, target_word string, target_word_normalized string, prompt_style_id string, source_trace string, raw_data string"
VALIDATED_LOG = "prompt_id string, category string, question_text string, target_word string, target_word_normalized string, prompt_style_id string, source_trace string, v_score string, p_sem string, s_score string, validation string"
VALIDATION = (
    "struct<is_one_word_answer_enforced:boolean,best_one_word_answer:string,top3_one_word_answers:array<string>,is_X_best:boolean,"
    "ambiguity_score:int,leaks_answer:boolean,naturalness_score:int,comments:string,v_score:int>"
)
DETECTIONS = (
    "prompt_id string, condition string, sample_id string, completion_text string, target_word string, word_present boolean, "
    "token_spans array<struct<start:int,end:int>>, mapping_error boolean, format_adherence boolean"
)
COUNTRIES = "name struct<common:string>, capital array<string>, currencies map<string,struct<name:string>>, languages map<string,string>, continents array<string>"
CONCEPT_EDGES = "subject string, relation string, object string, weight double"
