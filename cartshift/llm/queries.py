"""The operators of this package as queries over the shared tables, and SQL where SQL can say it."""

from __future__ import annotations

from .alignment import op11_alignment
from .automaton import op8_bpe
from .embeddings import op5_embedding_dedup
from .html import op1_main_text
from .katz import op7_katz
from .kmeans import OP12_SQL, op12_ns_bounds
from .lines import OP4_SQL, op4_line_dedup
from .mixing import OP2_SQL, op2_mixing
from .private import OP13_SQL, op13_private
from .quality import OP9_SQL, op9_host_rules
from .rollups import OP6_SQL, op6_token_rollup
from .simhash import op3_simhash
from .tokenfiles import op10_token_files

QUERIES = {
    q.__name__: q
    for q in (
        op1_main_text,
        op2_mixing,
        op3_simhash,
        op4_line_dedup,
        op5_embedding_dedup,
        op6_token_rollup,
        op7_katz,
        op8_bpe,
        op9_host_rules,
        op10_token_files,
        op11_alignment,
        op12_ns_bounds,
        op13_private,
    )
}

ORACLES = {
    "op2_mixing": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op6_token_rollup": OP6_SQL,
    "op9_host_rules": OP9_SQL,
    "op12_ns_bounds": OP12_SQL,
    "op13_private": OP13_SQL,
}
