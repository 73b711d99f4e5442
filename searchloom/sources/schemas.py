"""Declared schemas of every relation; no reader infers one."""

from __future__ import annotations

QUESTIONS = "question string, date date, relevance int, relevance_rank int"
QUERIES = "id bigint, question string, country string, date date, url string, relevance int, relevance_rank int"
HTMLS = "id bigint, country string, html string, date date"
EXTRACTIONS = (
    "id bigint, short_answer string, answer string, answer_url string, answer_type string, extract_v int, "
    "expanded_search boolean, corpus_docid string, match_score double, match_v int"
)
ARTICLES = "id string, revid string, url string, title string, text string"
PASSAGES = "docid string, title string, text string"
TRAINING_PASSAGES = "id string, contents string, title string"
DATASET = (
    "country string, id bigint, query string, docid string, docid_text string, query_date date, answer_date date, "
    "match_score float, expanded_search boolean, answer_type string, split string, id_country string"
)
TOPICS = "qid string, query string"
QRELS = "qid string, q0 string, docid string, rel int"
RUN = "qid string, q0 string, docid string, rank int, score double, tag string"
PREDICTIONS = "qid string, pid string, rank int, score double"
QA_PAIRS = "question string, answers string"
SCORED_IDS = "struct<doc_id:array<string>,score:array<double>>"
TRAINING_SAMPLE = f"query_id string, query string, positives {SCORED_IDS}, negatives {SCORED_IDS}"
EMBEDDINGS = "id string, embedding array<float>"
ID_MAP = "old_id string, new_id string"
GEOEDITORS = "wiki string, country string, activity_level string, lower_bound int, upper_bound int"
ANNOTATION_SHEET = "id string, query string, correct string, unambiguous string, relevant string"
ANNOTATION_RECORD = (
    "id string, fields struct<query:string,text:string>, "
    "responses map<string,array<struct<user_id:string,value:string>>>"
)
NESTED_QA = (
    "data array<struct<title:string,paragraphs:array<struct<context:string,"
    "qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"
)
SUGGESTIONS = "prefix string, country string, suggestion string, relevance int, rank int"

#: Relations that a warehouse keeps as tables.
TABLES = {"queries": QUERIES, "htmls": HTMLS, "extractions": EXTRACTIONS}
