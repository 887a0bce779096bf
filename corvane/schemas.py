"""Row shapes at the edges of the engine, as Spark DDL."""

from __future__ import annotations

CORPUS = "doc_id string, title string, text string"
DOCUMENT = "doc_id string, doc string"
VECTOR = "doc_id string, pos long, embedding array<float>"
CURSOR = "lines_consumed long"
IDENTIFIER = "struct<type: string, identifier: string, label: string>"
ATTRIBUTE = "struct<dimension: string, options: array<string>>"
ATTRIBUTED = f"doc_id string, doc string, identifiers array<{IDENTIFIER}>, attributes array<{ATTRIBUTE}>"
QUERY = "struct<query: string, used_identifier: array<string>, used_attributes: map<string, string>>"
QUERY_BATCH = f"{ATTRIBUTED}, queries array<{QUERY}>"
CANDIDATE = "struct<doc_id: string, doc: string, score: double, rank: int, is_original: boolean>"
ANNOTATION = "struct<doc_id: string, score: int, classification: string, reasoning: string>"
ANNOTATED = f"query string, candidates array<{CANDIDATE}>, pos_score double, annotations array<{ANNOTATION}>, positive_doc_ids array<string>, hard_negative_doc_ids array<string>, easy_negative_doc_ids array<string>"
MINED = "doc_id string, origin_doc string, queries array<struct<query: string, pos: array<string>, neg: array<string>, pos_doc_id: string, neg_doc_ids: array<string>, pos_score: double>>"
TRAINING = "prompt string, query string, pos array<string>, neg array<string>"
QRELS = "query_id string, doc_id string, rel int"
RUN = "query_id string, doc_id string, score double, rank int"
HUMAN_SCORE = "annotator_id string, sample_id string, dataset string, score int"
SAMPLE = "sample_id string, dataset string, query string, document string"
CALIBRATION = "query_id string, query string, doc_id string, doc string, expected_label string"
TASK = "task string, query_type string, doc_type string, relevance_definition string"
FEW_SHOT = "task string, query string, positive string, hard_negative string"
LENGTH_BUCKET = "label string, word_min long, word_max long, probability double"
ARTEFACT = "task string, kind string, created_at timestamp, role string, attempt int, text string"
