"""The queries of this folder by name, and SQL for those that SQL can express."""

from __future__ import annotations

from themeloom.llm.alignment import op13_alignment
from themeloom.llm.decontaminate import op10_decontamination
from themeloom.llm.fingerprints import op9_fingerprints
from themeloom.llm.line_dedup import op1_line_dedup
from themeloom.llm.mixing import op4_mixing
from themeloom.llm.near_dedup import op7_near_dedup
from themeloom.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from themeloom.llm.quality import op3_quality
from themeloom.llm.sharding import op8_sharding
from themeloom.llm.token_counts import op5_token_counts
from themeloom.llm.token_files import op6_token_files
from themeloom.llm.topk_search import OP12_SQL, op12_topk_search
from themeloom.llm.toxicity import op2_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_toxicity,
        op3_quality,
        op4_mixing,
        op5_token_counts,
        op6_token_files,
        op7_near_dedup,
        op8_sharding,
        op9_fingerprints,
        op10_decontamination,
        op11_prefix_trie,
        op12_topk_search,
        op13_alignment,
    )
}

SQL: dict[str, str] = {"op11_prefix_trie": OP11_SQL, "op12_topk_search": OP12_SQL}
