"""Schemas of the engine's tables."""

from __future__ import annotations

CHUNK_TYPES = ("function", "class", "method", "import", "comment", "other")

FILES = "path string, content binary"
CHUNKS = (
    "id string, file_path string, language string, content string, chunk_type string, start_line int, end_line int, "
    "metadata map<string,string>, dependencies array<string>, embedding array<float>"
)
PARSED = "file_path string, language string, content string, chunk_type string, start_line int, end_line int, metadata map<string,string>, seq int"
POSTINGS = "term string, id string, tf bigint"
MANIFEST = "path string, md5 string, mtime double"
EVENTS = "path string, event string, ts timestamp"
