"""Table schemas and the fixed vocabulary shared by every phase."""

from __future__ import annotations

AUDIT = (
    "created_by string, created_at timestamp_ntz, updated_by string, "
    "updated_at timestamp_ntz, is_deleted boolean"
)

CONTEXT_TYPE = (
    "struct<doc_id:string,chunk_id:string,text:string,similarity_score:double,"
    "metadata:struct<page_number:int,token_count:int>>"
)

SCORE_DDL = "array<struct<metric_name:string,score:double,reasoning:string>>"

_DDL = {
    "documents": "doc_id string, doc_name string, description string, "
    "metadata struct<file_path:string,total_pages:int,md5_hash:string>",
    "topics": "topic_id string, topic_name string",
    "document_topics": "doc_id string, topic_id string",
    "document_chunks": "id string, doc_id string, chunking_strategy string, chunk_index int, "
    "content string, metadata struct<page_number:int,token_count:int>, embedding array<float>",
    "inference_run_history": "run_id string, start_time timestamp_ntz, end_time timestamp_ntz, "
    "chunking_config string, indexing_config string, reranking_config string, "
    "prompting_config string, generation_config string, cost_estimate double",
    "evaluation_job_history": "job_id string, inference_run_id string, start_time timestamp_ntz, "
    "end_time timestamp_ntz, evaluator_model string, evaluator_prompt_version string",
    "evaluation_metrics": "id string, job_id string, query_id string, evaluation_strategy string, "
    "metric_category string, metric_name string, metric_value decimal(5,4), reasoning string",
    "query_history": "query_id string, queried_by string, question string, "
    f"retrieved_contexts array<{CONTEXT_TYPE}>, "
    "generated_answer string, query_time timestamp_ntz, retrieval_time timestamp_ntz, "
    "response_time timestamp_ntz",
    "golden_records": "id string, batch_name string, question string, ground_truth string, "
    "expected_topics array<string>, complexity string",
    "golden_record_query_mapping": "query_id string, golden_record_id string",
    "inference_run_query_mapping": "run_id string, query_id string",
}

# documents that were soft-deleted, with chunks and topics, after their files were written
_DDL["retired_documents"] = "doc_id string"

TABLES: dict[str, str] = {name: f"{ddl}, {AUDIT}" for name, ddl in _DDL.items()}

# --- fixed values: names that stored rows and reports must carry ---------------
CASE1 = "CASE1_GROUND_TRUTH"
CASE2 = "CASE2_RAG_TRIAD"
METRIC_CATEGORY = "generation"
METRICS = (
    "context_relevance",
    "faithfulness",
    "answer_relevance",
    "correctness",
    "semantic_similarity",
)
CHUNKING_STRATEGY = "RecursiveCharacterTextSplitter"
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
CHUNK_SEPARATORS = ("\n\n", "\n", " ", "")
EMBEDDING_DIMENSION = 768
EMBEDDING_BATCH = 100
EMBEDDING_ATTEMPTS = 5
TOP_K = 5
SIMILARITY_THRESHOLD = 0.5
SEED_MIN_LENGTH = 300
UNKNOWN_RUN = "UNKNOWN_RUN"
NOT_FOUND = "NOT_FOUND"
BLIND_DATASET = "case2_blind_test_dataset"
NO_CONTEXT = "<NO CONTEXT RETRIEVED>"
NO_ANSWER = (
    "I'm sorry, I couldn't find any relevant information in the knowledge base "
    "to answer your question."
)
INVALID_CHUNK = "INVALID_CHUNK"
REJECTED = "REJECTED"
EXPORT_HEADER = (
    "Query ID",
    "Question",
    "Retrieved Contexts",
    "Generated Answer",
    "Golden Answer (Ground Truth)",
    "Context Relevance Score",
    "Context Relevance Reasoning",
    "Faithfulness Score",
    "Faithfulness Reasoning",
    "Answer Relevance Score",
    "Answer Relevance Reasoning",
    "Correctness Score",
    "Correctness Reasoning",
)
