"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from gleanflow.llm.chat import OP12_SQL, op12_chat_round_trip
from gleanflow.llm.decontaminate import op7_spaced_seed_decontamination
from gleanflow.llm.mixing import op10_pfair_mixture
from gleanflow.llm.quality import op6_weak_supervision
from gleanflow.llm.revisits import OP5_SQL, op5_warc_revisits
from gleanflow.llm.sharding import op3_stratified_shards
from gleanflow.llm.simhash import op1_simhash_vptree
from gleanflow.llm.substrings import OP8_SQL, op8_radix_suffixes
from gleanflow.llm.surrogates import op4_pii_surrogates
from gleanflow.llm.tokens import op2_digest_cache_tokens
from gleanflow.llm.variants import OP11_SQL, op11_trie_pair_variants
from gleanflow.llm.whitening import op13_chebyshev_whitening
from gleanflow.llm.wrappers import op9_wrapper_text

QUERIES = {
    "op1_simhash_vptree": op1_simhash_vptree,
    "op2_digest_cache_tokens": op2_digest_cache_tokens,
    "op3_stratified_shards": op3_stratified_shards,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_weak_supervision": op6_weak_supervision,
    "op7_spaced_seed_decontamination": op7_spaced_seed_decontamination,
    "op8_radix_suffixes": op8_radix_suffixes,
    "op9_wrapper_text": op9_wrapper_text,
    "op10_pfair_mixture": op10_pfair_mixture,
    "op11_trie_pair_variants": op11_trie_pair_variants,
    "op12_chat_round_trip": op12_chat_round_trip,
    "op13_chebyshev_whitening": op13_chebyshev_whitening,
}
ORACLES: dict[str, str] = {
    "op5_warc_revisits": OP5_SQL,
    "op8_radix_suffixes": OP8_SQL,
    "op11_trie_pair_variants": OP11_SQL,
    "op12_chat_round_trip": OP12_SQL,
}
