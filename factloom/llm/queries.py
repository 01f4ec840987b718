"""The registered queries of the thirteen operators and of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_bpe
from .conversation_trie import op11_conversation_trie
from .divergence import op12_divergence
from .jaccard import op8_jaccard
from .katz import op5_katz
from .language import op13_language
from .mixing import op10_mixing
from .neighbours import op4_neighbours
from .oracles import OP7_REPEATS, OP8_JACCARD, OP11_CONVERSATION_TRIE, OP12_DIVERGENCE
from .pii import op2_pii
from .quality import op6_quality
from .repeats import op7_repeats
from .sharding import op9_sharding
from .token_counts import op1_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_pii": op2_pii,
    "op3_bpe": op3_bpe,
    "op4_neighbours": op4_neighbours,
    "op5_katz": op5_katz,
    "op6_quality": op6_quality,
    "op7_repeats": op7_repeats,
    "op8_jaccard": op8_jaccard,
    "op9_sharding": op9_sharding,
    "op10_mixing": op10_mixing,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_divergence": op12_divergence,
    "op13_language": op13_language,
}
ORACLES: dict[str, str] = {"op7_repeats": OP7_REPEATS, "op8_jaccard": OP8_JACCARD, "op11_conversation_trie": OP11_CONVERSATION_TRIE, "op12_divergence": OP12_DIVERGENCE}
