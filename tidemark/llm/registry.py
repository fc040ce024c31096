"""Queries of the corpus operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import licences, lines, mixing, packing, parsing, phrases, quality, simhash, suffixes, webp

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_licences": licences.op2_licences,
    "op3_packing": packing.op3_packing,
    "op4_simhash": simhash.op4_simhash,
    "op5_suffixes": suffixes.op5_suffixes,
    "op6_lines": lines.op6_lines,
    "op7_fingerprints": parsing.op7_fingerprints,
    "op8_phrases": phrases.op8_phrases,
    "op9_media": webp.op9_media,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES: dict[str, str] = {"op2_licences": licences.ORACLE_SQL, "op8_phrases": phrases.ORACLE_SQL}
