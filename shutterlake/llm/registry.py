"""Registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .chat_format import op5_chat_format
from .language_id import op6_language_id
from .line_dedup import op8_line_dedup
from .mixing import op10_mixing
from .ngram_join import op1_ngram_join
from .oracles import OP1, OP5, OP8, OP12
from .packing import op2_packing
from .quality_resampling import op4_quality_resampling
from .quality_rules import op9_quality_rules
from .spelling_variants import op13_spelling_variants
from .spot_signatures import op7_fingerprints
from .toxicity import op3_toxicity
from .warc import op12_warc
from .whitening import op11_whitening

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_quality_resampling": op4_quality_resampling,
    "op5_chat_format": op5_chat_format,
    "op6_language_id": op6_language_id,
    "op7_fingerprints": op7_fingerprints,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_warc": op12_warc,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {"op1_ngram_join": OP1, "op5_chat_format": OP5, "op8_line_dedup": OP8, "op12_warc": OP12}
