"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from driftlex.llm.chat import OP9_SQL, op9_preference_format
from driftlex.llm.decontaminate import OP4_SQL, op4_decontaminate
from driftlex.llm.filter_audit import OP13_SQL, op13_filter_audit
from driftlex.llm.language import op5_language_id
from driftlex.llm.licenses import OP6_SQL, op6_licenses
from driftlex.llm.mixing import op7_mixing
from driftlex.llm.ngram_join import OP2_SQL, op2_ngram_join
from driftlex.llm.pii import op1_pii
from driftlex.llm.quality import op12_quality
from driftlex.llm.secrets import op8_secrets
from driftlex.llm.timestamps import OP11_SQL, op11_timestamps
from driftlex.llm.topk import OP3_SQL, op3_topk
from driftlex.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_pii": op1_pii,
    "op2_ngram_join": op2_ngram_join,
    "op3_topk": op3_topk,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_licenses": op6_licenses,
    "op7_mixing": op7_mixing,
    "op8_secrets": op8_secrets,
    "op9_preference_format": op9_preference_format,
    "op10_toxicity": op10_toxicity,
    "op11_timestamps": op11_timestamps,
    "op12_quality": op12_quality,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": OP2_SQL,
    "op3_topk": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op6_licenses": OP6_SQL,
    "op9_preference_format": OP9_SQL,
    "op11_timestamps": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
