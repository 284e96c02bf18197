"""The registered queries of the corpus operators."""

from __future__ import annotations

from .binary import op10_token_files
from .divergence import OP11_SQL, op11_divergence
from .langid import op2_language
from .lines import OP5_SQL, op5_line_dedup
from .media import op8_media_copies
from .minhash import OP13_SQL, op13_near_dedup
from .mix import op1_mix
from .near import op7_near_join
from .pack import op4_pack
from .perplexity import op9_quality_rules
from .phrases import OP12_SQL, op12_phrases
from .quality import op3_quality
from .toxicity import op6_toxicity

QUERIES = {
    "op1_mix_sources": op1_mix,
    "op2_language_id": op2_language,
    "op3_quality_grade": op3_quality,
    "op4_best_fit_packing": op4_pack,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_near_join": op7_near_join,
    "op8_media_copies": op8_media_copies,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_files": op10_token_files,
    "op11_source_divergence": op11_divergence,
    "op12_phrase_mining": op12_phrases,
    "op13_minhash_dedup": op13_near_dedup,
}
ORACLES = {"op5_line_dedup": OP5_SQL, "op11_source_divergence": OP11_SQL, "op12_phrase_mining": OP12_SQL, "op13_minhash_dedup": OP13_SQL}
