"""The queries of this subpackage, by name, and SQL where it can say the same."""

from __future__ import annotations

from strata.llm.chat_prefixes import OP5_SQL, op5_chat_prefixes
from strata.llm.context_tree import op7_context_tree
from strata.llm.decontaminate import op10_decontaminate
from strata.llm.language_id import op2_language_id
from strata.llm.license_scan import OP12_SQL, op12_license_scan
from strata.llm.ngram_jaccard import op8_ngram_jaccard
from strata.llm.oracles import OP8_SQL, OP9_ABLATION_SQL, OP9_SQL, OP9_TOXIC_SQL, OP10_SQL
from strata.llm.periodic_runs import OP13_SQL, op13_periodic_runs
from strata.llm.quality_rules import op9_ablation, op9_quality_rules, op9_toxic_words
from strata.llm.run_index import op4_run_index
from strata.llm.secret_scan import op1_secret_scan
from strata.llm.spelling_variants import OP11_SQL, op11_spelling_variants
from strata.llm.warc_normalise import OP6_SQL, op6_warc_normalise
from strata.llm.word_bpe import op3_word_bpe

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_word_bpe": op3_word_bpe,
    "op4_run_index": op4_run_index,
    "op5_chat_prefixes": op5_chat_prefixes,
    "op6_warc_normalise": op6_warc_normalise,
    "op7_context_tree": op7_context_tree,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_quality_rules": op9_quality_rules,
    "op9_toxic_words": op9_toxic_words,
    "op9_ablation": op9_ablation,
    "op10_decontaminate": op10_decontaminate,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_license_scan": op12_license_scan,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL = {
    "op5_chat_prefixes": OP5_SQL,
    "op6_warc_normalise": OP6_SQL,
    "op8_ngram_jaccard": OP8_SQL,
    "op9_quality_rules": OP9_SQL,
    "op9_toxic_words": OP9_TOXIC_SQL,
    "op9_ablation": OP9_ABLATION_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_license_scan": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}
