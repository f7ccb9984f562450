"""Registered queries of the training-data operators: ``(spark, sf_dir) -> DataFrame``.

Operators 11 to 13 have oracle SQL. The others have none: each needs a hash, a tokenizer,
a fitted model, an HTML reader or a byte-level suffix order that SQL can't express, and
``tests/llm`` holds them against brute-force versions instead.
"""

from __future__ import annotations

from tesoro.llm.collocations import OP12_SQL, op12_phrase_collocations
from tesoro.llm.decontaminate import op5_decontamination
from tesoro.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from tesoro.llm.html_text import op1_html_extraction
from tesoro.llm.langid import op3_language_id
from tesoro.llm.language_model import op7_language_model
from tesoro.llm.mixture import op8_mixture
from tesoro.llm.simhash import op2_simhash_near_dedup
from tesoro.llm.substring_dedup import OP11_SQL, op11_substring_dedup
from tesoro.llm.suffix_dedup import op10_suffix_dedup
from tesoro.llm.token_output import op9_token_output
from tesoro.llm.topk import op6_exact_topk
from tesoro.llm.toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (
    op1_html_extraction,
    op2_simhash_near_dedup,
    op3_language_id,
    op4_toxicity,
    op5_decontamination,
    op6_exact_topk,
    op7_language_model,
    op8_mixture,
    op9_token_output,
    op10_suffix_dedup,
    op11_substring_dedup,
    op12_phrase_collocations,
    op13_fill_in_middle,
)}

ORACLE: dict[str, str] = {
    "op11_substring_dedup": OP11_SQL,
    "op12_phrase_collocations": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
