"""The registered queries of this subpackage, with oracle SQL where SQL can express them."""

from postlens.llm.alignment import op12_token_alignment
from postlens.llm.bpe import op7_bpe_encode_decode
from postlens.llm.lm import op6_lm_scoring
from postlens.llm.mixing import op3_mixing
from postlens.llm.neighbours import op10_nearest_neighbours
from postlens.llm.quality import op8_quality_rules
from postlens.llm.runs import op13_periodic_runs
from postlens.llm.sharding import op2_sharding
from postlens.llm.similarity import op9_ngram_jaccard_join
from postlens.llm.substrings import op5_substring_dedup
from postlens.llm.token_counts import op1_token_counts
from postlens.llm.toxicity import op4_toxicity
from postlens.llm.warc import op11_warc

CATALOG = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_sharding": (op2_sharding, None),
    "op3_mixing": (op3_mixing, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_substring_dedup": (op5_substring_dedup, None),
    "op6_lm_scoring": (op6_lm_scoring, None),
    "op7_bpe_encode_decode": (op7_bpe_encode_decode, None),
    "op8_quality_rules": (op8_quality_rules, None),
    "op9_ngram_jaccard_join": (op9_ngram_jaccard_join, None),
    "op10_nearest_neighbours": (op10_nearest_neighbours, None),
    "op11_warc": (op11_warc, None),
    "op12_token_alignment": (op12_token_alignment, None),
    "op13_periodic_runs": (op13_periodic_runs, None),
}
