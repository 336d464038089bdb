"""The queries of this subpackage, and their SQL where SQL can express them."""

from lodestar.llm import exact_dedup, jaccard_join, langid, mixing, neighbours, packing, pii, quality, secrets, url_filter

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_neighbours": neighbours.op2_neighbours,
    "op3_ngram_jaccard": jaccard_join.op3_ngram_jaccard,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_mixing": mixing.op5_mixing,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality": quality.op7_quality,
    "op8_pii": pii.op8_pii,
    "op9_packing": packing.op9_packing,
    "op10_secrets": secrets.op10_secrets,
}
ORACLE_SQL = {"op4_url_filter": url_filter.OP4_SQL, "op6_exact_dedup": exact_dedup.OP6_SQL}
