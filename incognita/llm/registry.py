"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import corpus_pipeline
from incognita.llm.op1_sharding import op1_sharding
from incognita.llm.op2_mixing import op2_mixing
from incognita.llm.op3_pseudonyms import op3_pseudonyms
from incognita.llm.op10_substrings import SQL as OP10_SQL
from incognita.llm.op10_substrings import op10_substrings
from incognita.llm.op11_importance import SQL as OP11_SQL
from incognita.llm.op11_importance import op11_importance
from incognita.llm.op12_html import op12_html
from incognita.llm.op13_centroids import SQL as OP13_SQL
from incognita.llm.op13_centroids import op13_centroids
from incognita.llm.op4_neardup import SQL as OP4_SQL
from incognita.llm.op4_neardup import op4_neardup
from incognita.llm.op5_quality import op5_quality
from incognita.llm.op6_secrets import op6_secrets
from incognita.llm.op7_pieces import op7_pieces
from incognita.llm.op8_topk import SQL as OP8_SQL
from incognita.llm.op8_topk import op8_topk
from incognita.llm.op9_rules import SQL as OP9_SQL
from incognita.llm.op9_rules import op9_rules

QUERIES = {"pipeline": corpus_pipeline.run, "op1_sharding": op1_sharding, "op2_mixing": op2_mixing, "op3_pseudonyms": op3_pseudonyms, "op4_neardup": op4_neardup, "op5_quality": op5_quality, "op6_secrets": op6_secrets, "op7_pieces": op7_pieces, "op8_topk": op8_topk, "op9_rules": op9_rules, "op10_substrings": op10_substrings, "op11_importance": op11_importance, "op12_html": op12_html, "op13_centroids": op13_centroids}
ORACLE = {"op4_neardup": OP4_SQL, "op8_topk": OP8_SQL, "op9_rules": OP9_SQL, "op10_substrings": OP10_SQL, "op11_importance": OP11_SQL, "op13_centroids": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
