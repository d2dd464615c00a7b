"""Schemas of the record families, as Spark DDL; readers never infer (maps would become structs)."""

#: A dataset row of the decision protocol; `ord` is its line in the source file.
DECISION = """ord LONG, schema STRING, split STRING, seed INT, history_id STRING, task STRING, difficulty STRING, vocabulary STRING,
entities ARRAY<STRING>, entity_pair_id STRING, policy MAP<STRING,STRING>, policy_id STRING, policy_order ARRAY<STRING>,
actions ARRAY<STRING>, currents ARRAY<STRING>, old_values ARRAY<STRING>, other_old STRING, other_current STRING,
historical_order ARRAY<INT>, current_order ARRAY<INT>, order_stratum STRING, template STRING, template_id STRING,
vocabulary_id STRING, history_signature STRING, family STRING, member INT, pair_id STRING, example_id STRING,
correct_state STRING, answer STRING, wrong_action STRING, prompt STRING, edit_span ARRAY<INT>"""

_GENERATED = "STRUCT<classification:STRING,relaxed_action:STRING>"

#: A score record of the decision protocol.
DECISION_SCORE = f"""example_id STRING, row_hash STRING, model_id STRING, action_logp MAP<STRING,DOUBLE>, easy_target MAP<STRING,DOUBLE>,
easy_other MAP<STRING,DOUBLE>, raw_text STRING, generated_token_ids ARRAY<INT>, terminated BOOLEAN, easy_raw_text STRING,
easy_token_ids ARRAY<INT>, easy_terminated BOOLEAN, eos_token_id INT, generated {_GENERATED}, easy_generated {_GENERATED},
canonical_valid_mass DOUBLE, prompt_tokens INT, history_position INT, record_sha256 STRING"""

#: A pair row of the relational protocol and its score.
RELATIONAL = """ord LONG, history_id STRING, history_index INT, seed INT, stage STRING, entities ARRAY<STRING>, variables ARRAY<STRING>,
attribute STRING, other_attribute STRING, orientation INT, matching_values MAP<STRING,STRING>, replacement_values MAP<STRING,STRING>,
concrete_signature STRING, condition STRING, historical_entity_order INT, current_entity_order INT, unassigned_slot_order STRING,
query STRING, query_entity STRING, edited_variable STRING, edited_field STRING, edited_entity STRING, edit_status STRING,
source_value STRING, replacement_value STRING, pair_id STRING, pair_direction INT, example_id STRING, candidate_values ARRAY<STRING>,
semantic_values MAP<STRING,STRING>, current_fields MAP<STRING,STRING>, obsolete_fields MAP<STRING,STRING>, answer STRING, stale_value STRING"""
RELATIONAL_SCORE = """example_id STRING, prompt STRING, score_kind STRING, semantic_log_mass MAP<STRING,DOUBLE>,
surface_likelihoods MAP<STRING,ARRAY<STRUCT<text:STRING,ids:ARRAY<INT>,log_probability:DOUBLE>>>, semantic_rank INT,
semantic_accuracy INT, greedy_token_id INT, generated_first_token STRING, full_vocab_next_token_accuracy INT, full_vocab_rank INT"""

#: A row of the version-chain protocol, scores included.
CHAIN = """ord LONG, history_id STRING, depth INT, stage STRING, seed INT, versions MAP<STRING,ARRAY<STRING>>, block_order ARRAY<STRING>,
edited_variable STRING, version_index INT, age_from_current INT, query STRING, pair_id STRING, pair_direction INT, example_id STRING,
source_value STRING, replacement_value STRING, candidate_values ARRAY<STRING>, answer STRING, candidate_logits MAP<STRING,DOUBLE>,
full_vocab_rank INT, candidate_rank INT, full_vocab_next_token_accuracy INT, accuracy INT"""

#: A patch fact.
PATCH = """history_id STRING, pair_id STRING, edited_binding STRING, query_id STRING, site_role STRING, layer INT, position INT,
direction STRING, head INT, token_id INT, token_text STRING, patch_delta_toward_donor DOUBLE, patch_correct_logit_delta DOUBLE,
patch_correct_margin_delta DOUBLE"""

TIMING = "records LONG, seconds DOUBLE, seconds_per_record DOUBLE, note STRING"
COMPLETION = "status STRING, records LONG, scores_sha256 STRING, easy_sha256 STRING, run_manifest_sha256 STRING"
