"""Registered queries of the package and their SQL, where SQL can express them."""

from __future__ import annotations

from llm import fill_in_middle, sharded_lloyd, source_mixing
from llm.bpe_chunks import op11_bpe_chunks
from llm.decontamination import op2_decontamination
from llm.embedding_neardup import op6_embedding_neardup
from llm.fill_in_middle import op12_fill_in_middle
from llm.main_text import op7_html_extraction
from llm.ngram_jaccard import op9_ngram_jaccard
from llm.pii import op5_pii
from llm.sharded_lloyd import op13_sharded_lloyd
from llm.source_mixing import op3_source_mixing
from llm.substring_dedup import op1_substring_dedup
from llm.token_files import op10_token_files
from llm.toxicity import op8_toxicity
from llm.warc import op4_warc

QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_decontamination, op3_source_mixing, op4_warc, op5_pii, op6_embedding_neardup,
    op7_html_extraction, op8_toxicity, op9_ngram_jaccard, op10_token_files,
    op11_bpe_chunks, op12_fill_in_middle, op13_sharded_lloyd)}

ORACLES = {"op3_source_mixing": source_mixing.oracle(), "op12_fill_in_middle": fill_in_middle.oracle(),
           "op13_sharded_lloyd": sharded_lloyd.oracle()}
