"""Column types shared by the operators, and fixed lists of kinds."""

from __future__ import annotations

CODE_KINDS = ("function", "class", "method", "class_header", "module_level")
PROTECTED_KINDS = ("query", "instruction", "system")
STRUCTURAL_KINDS = ("function", "method", "class")
MERGEABLE_KINDS = ("heading", "paragraph", "sentence", "list", "module_level", "other")

#: A chunk as the chunkers give it: `ord` counts from 0 in the document, characters from 0 (end exclusive), lines from 1.
CHUNK = (
    "doc_id bigint, id string, ord int, kind string, source string, start_line int, end_line int, start_char int, end_char int, "
    "text string, token_count int, symbol string, template string, level string, lines int, section string, heading_level int, "
    "language string, merged_parts int, split_part int, split_of int, forward_anchor boolean, fallback boolean"
)
NAMES = [f.split(" ")[0] for f in CHUNK.split(", ")]
