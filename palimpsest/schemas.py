"""Explicit schemas of the analytics tables; nothing is inferred."""

from __future__ import annotations

CHAIN = ["qid", "group", "instruction_type", "run"]
_KEY = "qid string, `group` string, instruction_type string, run int"
CHAINS = f"{_KEY}, question string, instruction_used string, step int, text string, n_tokens int"
CHAINS_WITH_GOLD = f"{CHAINS}, gold_answer string, gold_answer_aliases string"
CHAINS_REPEATED = f"{CHAINS}, repetition int"
CHAINS_REFINED = f"{CHAINS}, draft_text string, critic_feedback string, draft_n_tokens int"
ANSWER_F1 = f"{_KEY}, step int, question string, gold_answer string, predicted_answer string, matched_reference string, answer_f1 double"
FACT_SCORES = f"{_KEY}, step int, instruction_used string, n_facts int, n_supported int, n_not_supported int, n_contradicted int, init_score double, factscore double"
FACT_DETAILS = f"{_KEY}, step int, fact string, label string, raw string"
RECALL = f"{_KEY}, step int, n_e0_facts int, n_recalled int, n_not_recalled int, recall_init double, recall double"
BERTSCORE = f"{_KEY}, step int, bert_precision_original double, bert_recall_original double, bert_f1_original double, bert_precision_consecutive double, bert_recall_consecutive double, bert_f1_consecutive double"
BLEURT = f"{_KEY}, step int, bleurt_original double, bleurt_consecutive double, bleurt_answer double"
PERPLEXITY = f"{_KEY}, step int, n_tokens int, perplexity double"
EPISODES = "qid string, instruction_type string, run int, first_hit_step int, duration int, event_observed int, n_hop int"
QUESTIONS = "id string, question string, answer string, answer_aliases array<string>, question_decomposition array<struct<id:bigint,question:string,answer:string>>, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
STORIES = "story_id string, question string, answer_char_ranges string, is_answer_absent string, is_question_bad string, validated_answers string, story_text string"
