"""Record shapes and fixed domains of the paired-output audit."""

from __future__ import annotations

#: Ordinal severities, least first.
SEVERITIES = ("none", "mild", "moderate", "severe", "extreme")
UNKNOWN_POLICY = "policy_unknown"

SAMPLE = "sample_id string, source string, prompt string, gold_label string, split string, meta string"
GENERATION_PARAMS = "struct<max_new_tokens:bigint,temperature:double,top_p:double,top_k:bigint,do_sample:boolean,num_beams:bigint,repetition_penalty:double,stop_sequences:array<string>>"
PREDICTION = (
    f"{SAMPLE}, model_id string, base_model string, adapter_path string, policy_id string, timestamp_utc string, raw_text string, parsed_analysis string, "
    f"parsed_conclusion string, parse_ok boolean, parse_issues array<string>, analysis_sentence_count bigint, generation_params {GENERATION_PARAMS}, "
    "runtime struct<batch_elapsed_sec:double,batch_size_effective:bigint,index_in_batch:bigint>"
)
SIDE = "struct<model_id:string,base_model:string,adapter_path:string,raw_text:string,parsed_analysis:string,parsed_conclusion:string,parse_ok:boolean,parse_issues:array<string>>"
PAIRED = f"{SAMPLE}, policy_id string, paired struct<A:{SIDE},B:{SIDE}>"
TEACHER = (
    f"{SAMPLE}, task string, teacher_model string, teacher_provider string, timestamp_utc string, raw_text string, parsed_analysis string, parsed_conclusion string, "
    "success boolean, parse_ok boolean, parse_issues array<string>, violations array<string>, messages array<struct<role:string,content:string>>, severity_bin string, error string"
)
SCORE = "scorer_id string, text_hash string, score double, created_utc string"
JUDGE = "text_hash string, is_harmful boolean, severity string, reason string, categories array<string>, success boolean, error string"
