"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from leafspan.llm.decontaminate import OP9_SQL, op9_decontaminate
from leafspan.llm.embedding_dedup import OP4_SQL, op4_embedding_dedup
from leafspan.llm.importance import op1_importance_resampling
from leafspan.llm.language_id import op3_language_id
from leafspan.llm.mixing import OP8_SQL, op8_mixing
from leafspan.llm.ngram_join import OP5_SQL, op5_ngram_join
from leafspan.llm.pii import op10_pii
from leafspan.llm.repeats import op6_repeats
from leafspan.llm.secret_scan import op7_secret_scan
from leafspan.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_repeats": op6_repeats,
    "op7_secret_scan": op7_secret_scan,
    "op8_mixing": op8_mixing,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii": op10_pii,
}

SQL = {
    "op4_embedding_dedup": OP4_SQL,
    "op5_ngram_join": OP5_SQL,
    "op8_mixing": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
}
