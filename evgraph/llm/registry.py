"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from evgraph.llm import ngram_join, substring_dedup
from evgraph.llm.adaptive_scan import op3_adaptive_scan
from evgraph.llm.bpe_chunks import op9_bpe_chunks
from evgraph.llm.language_id import op1_language_id
from evgraph.llm.mixing import op4_mixing
from evgraph.llm.ngram_join import op8_ngram_join
from evgraph.llm.periodic_runs import op12_periodic_runs
from evgraph.llm.quality_rules import op6_quality_rules
from evgraph.llm.ring_sharding import op10_ring_sharding
from evgraph.llm.simhash_partitions import op13_simhash_partitions
from evgraph.llm.substring_dedup import op7_substring_dedup
from evgraph.llm.suffix_dedup import op5_suffix_dedup
from evgraph.llm.token_alignment import op11_token_alignment
from evgraph.llm.toxicity import op2_toxicity


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_toxicity": op2_toxicity,
        "op3_adaptive_scan": op3_adaptive_scan,
        "op4_mixing": op4_mixing,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_quality_rules": op6_quality_rules,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_ngram_join": op8_ngram_join,
        "op9_bpe_chunks": op9_bpe_chunks,
        "op10_ring_sharding": op10_ring_sharding,
        "op11_token_alignment": op11_token_alignment,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_simhash_partitions": op13_simhash_partitions,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the rows; tests hold the other operators against brute force."""
    return {"op7_substring_dedup": substring_dedup.ORACLE, "op8_ngram_join": ngram_join.ORACLE}
