"""The thin opN_<name> queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .chunk_bpe import op11_bpe_chunks
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .license_scan import op3_license_scan
from .mixing import op7_mixing
from .oracles import OP4_SQL, OP8_SQL, OP13_SQL
from .packing import op1_best_fit_packing
from .passage_dedup import op5_passage_dedup
from .prefix_trie import op13_prefix_trie
from .quality_rules import op4_quality_rules
from .sharding import op8_sharding
from .simhash import op10_simhash_near_dedup
from .toxicity import op6_toxicity
from .url_filter import op2_url_filter
from .whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_url_filter, op3_license_scan, op4_quality_rules, op5_passage_dedup, op6_toxicity, op7_mixing, op8_sharding, op9_exact_dedup, op10_simhash_near_dedup, op11_bpe_chunks, op12_whitening, op13_prefix_trie)}
ORACLE_SQL: dict[str, str] = {"op4_quality_rules": OP4_SQL, "op8_sharding": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op13_prefix_trie": OP13_SQL}
