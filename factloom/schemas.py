"""The relations: raw document graphs, facts, dependencies, links, corrections."""

from __future__ import annotations

FACT = (
    "id string, entity string, role string, value string, raw_text string, timex_type string, sentence string, date_parsed string, duration_days int, "
    "start_char int, end_char int, confidence double, signal_verb string, signal_prep string, is_duplicate_of string, temporal_content boolean"
)
DEPENDENCY = (
    "from_id string, to_id string, constraint_type string, constraint_expr string, delta_days int, confidence double, verified boolean, "
    "allen_relation string, corroboration_count int"
)
DOCUMENT = (
    "schema_version string, document_id string, document_type string, source_text string, source_text_sha256 string, matter string, "
    f"parties string, facts array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in FACT.split(', '))}>>, "
    f"dependencies array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in DEPENDENCY.split(', '))}>>, _corrupt string"
)
CORRECTION = "op string, doc_id string, fact_id string, new_date string, new_label string, keys array<array<string>>, note string, was string, ts string"
CORRECTION_OPS = ("accept", "reject", "edit_date", "edit_label", "merge", "split")
ROLES = ("START", "END", "DURATION", "CONTAINS", "UNKNOWN")
CONSTRAINTS = ("additive", "ordering", "interval", "periodic")
