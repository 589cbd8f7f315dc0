"""Explicit read schemas; nothing is inferred, so files of other runs with more or fewer fields read alike."""

CONVERSATIONS = "conversations array<struct<role: string, content: string>>, dataset_name string, row_idx long"
SELECTED = "question array<string>, answer array<string>, context array<array<struct<chunk_id: int, chunk: string, overlap: int>>>"
GENERATED = "row_idx long, question string, predict string, label string, context_lst array<string>, meta_info struct<dataset_name: string, process_turns: int, path_nums: int>"
PREFERENCE = "all_ref_text array<string>, combined_question string, final_answer string, label string, prefix_a string, siffix_a string"
PREDICTION = "dataset_name string, pred_str string, answers array<string>, length long"
CHOICE_SOURCE = "domain string, difficulty string, length string, question string, choice_A string, choice_B string, choice_C string, choice_D string, answer string, context string"
CHOICE_PREDICTION = "dataset_name string, pred string, output string, context string, answers string, judge boolean, length string, difficulty string"
FACT_PREDICTION = "golden string, task string, ctx_length string, question string, pred string"
FACT_PREDICTION_LISTS = "golden string, task string, ctx_length string, question string, pred array<string>"
TOKENS = "doc_id long, pos int, s long, e long, loss_full double, loss_short double"
KEY_SPANS = "doc_id long, s long, e long"
DOCUMENTS = "question string, answers array<string>, ctxs array<struct<title: string, text: string, id: string, score: double, hasanswer: boolean, isgold: boolean, original_retrieval_index: int>>"
SCORED_DOCUMENTS = DOCUMENTS + ", model_answer string"
TRAINING = ", ".join(f"{kind}_{part} array<int>" for kind in ("chosen", "reject_1", "reject_2") for part in ("input_ids", "attention_mask", "position_ids", "labels"))
KEYED = "map<string, struct<system_prompt: variant, query: array<string>, call_parameters: array<variant>, source_docs: array<variant>, user_second_query: array<string>, retrieval_res: array<variant>>>"
