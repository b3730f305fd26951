"""The registered queries of this subpackage and their SQL."""

from . import chat, codes, decontam, mixing, neardup, quality, repeats, reputation, sstable, suffixtree, tokencount, warc, whitening

_ALL = {
    "op1_quality_rules": quality,
    "op2_benchmark_decontamination": decontam,
    "op3_chat_formatting": chat,
    "op4_lm_scoring": suffixtree,
    "op5_warc": warc,
    "op6_token_counts": tokencount,
    "op7_source_mixing": mixing,
    "op8_token_sstable": sstable,
    "op9_repeat_removal": repeats,
    "op10_minhash_neardup": neardup,
    "op11_url_reputation": reputation,
    "op12_embedding_whitening": whitening,
    "op13_vector_codes": codes,
}
QUERIES = {name: module.query for name, module in _ALL.items()}
ORACLE = {name: module.ORACLE for name, module in _ALL.items() if getattr(module, "ORACLE", None)}
