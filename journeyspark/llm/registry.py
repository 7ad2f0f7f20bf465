"""The queries of this subpackage and their SQL."""

from importlib import import_module

#: query -> module that holds it
MODULES = {
    "op1_mixing": "mixing",
    "op2_sharding": "sharding",
    "op3_pii": "pii",
    "op4_language_id": "language_id",
    "op5_topk_search": "topk_search",
    "op6_sentencepiece": "sentencepiece",
    "op7_quality_rules": "quality_rules",
    "op8_line_dedup": "line_dedup",
    "op9_quality_classifier": "quality_classifier",
    "op10_jaccard_join": "jaccard_join",
    "op11_best_fit_packing": "packing",
    "op12_embedding_whitening": "whitening",
    "op13_prefix_trie": "prefix_trie",
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{module}", __package__), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
