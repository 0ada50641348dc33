"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from graphlode.llm.bpe import op7_bpe
from graphlode.llm.chat import op9_chat_formatting
from graphlode.llm.fingerprint import op8_fingerprints
from graphlode.llm.language import op5_language_id
from graphlode.llm.linededup import OP6_SQL, op6_line_dedup
from graphlode.llm.mixing import OP4_SQL, op4_mixing
from graphlode.llm.neardup import op10_minhash_near_dedup
from graphlode.llm.quality import op2_quality_rules
from graphlode.llm.toxicity import op1_toxicity
from graphlode.llm.unigram import op3_token_counts

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_bpe": op7_bpe,
    "op8_fingerprints": op8_fingerprints,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}
ORACLE: dict[str, str] = {"op4_mixing": OP4_SQL, "op6_line_dedup": OP6_SQL}
