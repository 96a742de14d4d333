"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from .chat_format import OP2_SQL, op2_chat_formatting
from .decontamination import OP13_SQL, op13_decontamination
from .embedding_dedup import op7_embedding_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language_id import op5_language_id
from .lm_scoring import op10_lm_scoring
from .minhash_dedup import op1_minhash_dedup
from .packing import op6_best_fit_packing
from .quality_classifier import op9_quality_classifier
from .quality_rules import op3_quality_rules
from .sentence_pieces import op8_sentence_pieces
from .sharding import op4_sharding
from .token_alignment import op12_token_alignment

QUERIES = {f.__name__: f for f in (
    op1_minhash_dedup, op2_chat_formatting, op3_quality_rules, op4_sharding, op5_language_id,
    op6_best_fit_packing, op7_embedding_dedup, op8_sentence_pieces, op9_quality_classifier,
    op10_lm_scoring, op11_hard_negatives, op12_token_alignment, op13_decontamination)}

SQL = {"op2_chat_formatting": OP2_SQL, "op11_hard_negatives": OP11_SQL,
       "op13_decontamination": OP13_SQL}
