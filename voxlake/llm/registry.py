"""The operators' registered queries and their DuckDB twins."""

from __future__ import annotations

from voxlake.llm.bpe import op3_bpe
from voxlake.llm.jaccard import op10_jaccard
from voxlake.llm.licences import op6_licences
from voxlake.llm.mixing import op7_mixing
from voxlake.llm.packing import op13_packing
from voxlake.llm.prefixes import OP11_SQL, op11_prefix_trie
from voxlake.llm.repair import OP12_SQL, op12_structure_repair
from voxlake.llm.suffixes import op1_suffix_dedup
from voxlake.llm.toxicity import op2_toxicity
from voxlake.llm.urls import OP8_SQL, op8_url_filter
from voxlake.llm.vectors import OP4_SQL, op4_topk, op5_ann
from voxlake.llm.warc import OP9_SQL, op9_warc

QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_toxicity": op2_toxicity, "op3_bpe": op3_bpe, "op4_topk": op4_topk, "op5_ann": op5_ann, "op6_licences": op6_licences, "op7_mixing": op7_mixing, "op8_url_filter": op8_url_filter, "op9_warc": op9_warc,
    "op10_jaccard": op10_jaccard, "op11_prefix_trie": op11_prefix_trie, "op12_structure_repair": op12_structure_repair, "op13_packing": op13_packing}
ORACLES = {"op4_topk": OP4_SQL, "op8_url_filter": OP8_SQL, "op9_warc": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_structure_repair": OP12_SQL}
