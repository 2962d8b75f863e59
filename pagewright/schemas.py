"""Explicit schemas (DDL) of the tables that the operators exchange."""

from __future__ import annotations


PAGES = "doc_id string, page_number int, raw_text string, cleaned_text string, line_list array<string>, metadata map<string,double>"
SECTIONS = "doc_id string, section_idx int, section_id string, title string, sec_level int, page_start int, page_end int, text string, source_pdf string"
CHUNKS = "doc_id string, chunk_id string, section_id string, section_title string, page_start int, page_end int, token_count int, char_count int, text string"
PAIRS = "pair_id bigint, anchor string, positive string"
QUERY_PASSAGES = "query string, passage string, doc_id string, chunk_id string, section_id string, section_title string, page_start int, page_end int, token_count int, char_count int"
TIMING = "function_name string, duration double, timestamp double"
LOSSES = "epoch int, loss double"
PARAMETERS = "name string, numel bigint, trainable boolean"
STATISTICS = (
    "pdf_path string, doc_id string, config struct<max_tokens:int,overlap_tokens:int,min_tokens:int,min_heading_score:double>, "
    "statistics struct<num_pages:bigint,num_sections:bigint,num_chunks:bigint,total_tokens:bigint,avg_tokens_per_chunk:double,min_tokens:bigint,median_tokens:double,max_tokens:bigint>, parquet_path string"
)
