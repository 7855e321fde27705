"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from coverlake.llm.decontaminate import q_decontaminate
from coverlake.llm.html_text import q_html_text
from coverlake.llm.language import q_language
from coverlake.llm.line_dedup import LINES_SQL, q_line_dedup
from coverlake.llm.near_copies import q_jaccard_join
from coverlake.llm.phrases import PHRASES_SQL, q_phrases
from coverlake.llm.pieces import q_pieces
from coverlake.llm.preferences import PREFERENCES_SQL, q_preferences
from coverlake.llm.quality import QUALITY_SQL, q_quality
from coverlake.llm.resample import RESAMPLE_SQL, q_resample
from coverlake.llm.secrets import q_secrets
from coverlake.llm.surrogates import q_surrogates
from coverlake.llm.token_frames import q_token_frames

QUERIES = {
    "op1_secrets": q_secrets,
    "op2_quality_rules": q_quality,
    "op3_token_frames": q_token_frames,
    "op4_surrogates": q_surrogates,
    "op5_jaccard_join": q_jaccard_join,
    "op6_preferences": q_preferences,
    "op7_language": q_language,
    "op8_pieces": q_pieces,
    "op9_html_text": q_html_text,
    "op10_decontaminate": q_decontaminate,
    "op11_phrases": q_phrases,
    "op12_resample": q_resample,
    "op13_line_dedup": q_line_dedup,
}
ORACLES = {
    "op6_preferences": PREFERENCES_SQL,
    "op2_quality_rules": QUALITY_SQL,
    "op11_phrases": PHRASES_SQL,
    "op12_resample": RESAMPLE_SQL,
    "op13_line_dedup": LINES_SQL,
}
