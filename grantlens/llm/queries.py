"""Registered queries of the training-data operators; oracle SQL where SQL can express them."""

from __future__ import annotations

from . import chat, divergence, line_dedup, mixing, periodic, secrets
from .ann import op10_permutation_ann
from .bpe import op6_bpe
from .chat import op7_chat_format
from .decontaminate import op3_decontamination
from .divergence import op12_source_divergence
from .langid import op1_language_id
from .line_dedup import op9_line_dedup
from .maxent_lm import op4_lm_scoring
from .mixing import op13_source_mix
from .ngram_join import op2_ngram_jaccard
from .periodic import op11_periodic_runs
from .quality import op8_quality
from .secrets import op5_secrets

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_decontamination": op3_decontamination,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_secrets": op5_secrets,
    "op6_bpe": op6_bpe,
    "op7_chat_format": op7_chat_format,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_permutation_ann": op10_permutation_ann,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_source_mix": op13_source_mix,
}

ORACLE: dict[str, str] = {
    "op5_secrets": secrets.ORACLE_SQL,
    "op7_chat_format": chat.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op11_periodic_runs": periodic.ORACLE_SQL,
    "op12_source_divergence": divergence.ORACLE_SQL,
    "op13_source_mix": mixing.ORACLE_SQL,
}
