"""Schemas of the tables: documents, chunks, search hits, highlights, citations, answers."""

from __future__ import annotations

DOCUMENT = "id string, title string, source string, content_type string, raw_content string, metadata map<string,string>, created_at timestamp"
CHUNK = "id string, document_id string, chunk_number int, text string, enhanced_text string, chunk_type string, start int, end int, metadata map<string,string>, user_id string, dataset_id string"
HIT = "question_id string, id string, score double, rank int, text string, metadata map<string,string>"
HIGHLIGHT = "struct<text:string,start:int,end:int>"
CITATION = "struct<text:string,doc_index:int,highlight_index:int,number:int,type:string>"
CONTEXT = "content string, text string, title string, source string, metadata map<string,string>"

#: Document types and chunk types.
DOCUMENT_TYPES = ("pdf", "docx", "html", "web_page", "txt", "markdown", "csv", "json", "unknown")
CHUNK_TYPES = ("paragraph", "heading", "list", "table", "code", "quote", "caption", "footnote", "equation", "unknown")

#: Content types by file extension.
CONTENT_TYPES = {
    "pdf": "pdf",
    "docx": "docx",
    "html": "html",
    "htm": "html",
    "txt": "txt",
    "md": "markdown",
    "markdown": "markdown",
    "csv": "csv",
    "json": "json",
}
