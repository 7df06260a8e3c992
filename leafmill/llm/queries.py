"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from leafmill.llm.centroids import OP12_SQL, op12_centroids
from leafmill.llm.decontaminate import op6_decontaminate
from leafmill.llm.main_text import op4_main_text
from leafmill.llm.packing import op5_packing
from leafmill.llm.periodic import op11_periodic_runs
from leafmill.llm.quality import op8_quality
from leafmill.llm.simhash_trie import op1_simhash_trie
from leafmill.llm.suffix_repeats import op7_suffix_repeats
from leafmill.llm.tokens import op9_token_counts
from leafmill.llm.toxicity import op2_toxicity
from leafmill.llm.url_rules import OP13_SQL, op13_url_rules
from leafmill.llm.warc import OP3_SQL, op3_warc_fixity
from leafmill.llm.word_repeats import op10_word_repeats

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_trie, op2_toxicity, op3_warc_fixity, op4_main_text, op5_packing, op6_decontaminate, op7_suffix_repeats, op8_quality, op9_token_counts, op10_word_repeats,
        op11_periodic_runs, op12_centroids, op13_url_rules,
    )
}

#: SQL can express the fixity audit, the clustering's rounds and the URL rules; tests hold the others against brute force, the library or held-out labels.
ORACLE_SQL: dict[str, str] = {"op3_warc_fixity": OP3_SQL, "op12_centroids": OP12_SQL, "op13_url_rules": OP13_SQL}
