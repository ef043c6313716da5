"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from .bpe import op12_bpe_round_trip
from .context_tree import op8_context_tree
from .decontaminate import op6_benchmark_overlaps
from .divergence import OP11_SQL, op11_source_divergence
from .html_text import op7_html_text
from .lexical import OP13_SQL, op13_lexical_search
from .licenses import op5_license_scan
from .mixing import OP4_SQL, op4_source_mix
from .near_dup import OP9_SQL, op9_setsketch_near_dup
from .neighbours import op10_hnsw_search
from .quality import op1_quality_pu
from .suffix_dedup import OP3_SQL, op3_suffix_dedup
from .toxicity import op2_toxicity_ssk

QUERIES = {
    "op1_quality_pu": op1_quality_pu,
    "op2_toxicity_ssk": op2_toxicity_ssk,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_source_mix": op4_source_mix,
    "op5_license_scan": op5_license_scan,
    "op6_benchmark_overlaps": op6_benchmark_overlaps,
    "op7_html_text": op7_html_text,
    "op8_context_tree": op8_context_tree,
    "op9_setsketch_near_dup": op9_setsketch_near_dup,
    "op10_hnsw_search": op10_hnsw_search,
    "op11_source_divergence": op11_source_divergence,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE = {"op3_suffix_dedup": OP3_SQL, "op4_source_mix": OP4_SQL, "op9_setsketch_near_dup": OP9_SQL, "op11_source_divergence": OP11_SQL, "op13_lexical_search": OP13_SQL}
