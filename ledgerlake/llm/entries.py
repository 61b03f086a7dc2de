"""Queries of this subpackage and their DuckDB oracles, for __spark_entry__.py."""

from __future__ import annotations

import corpus_pipeline

from . import chat, decontaminate, merkle, ngramjoin, pieces, quality, repeats, secrets, simhash, topk, url_filter, warc, wordtrie

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_chat_format": chat.op2_chat_format,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_suffix_dedup": repeats.op4_suffix_dedup,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_warc": warc.op6_warc,
    "op7_importance_resampling": quality.op7_importance_resampling,
    "op8_simhash": simhash.op8_simhash,
    "op9_secret_ledger": secrets.op9_secret_ledger,
    "op10_top_k": topk.op10_top_k,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_ngram_join": ngramjoin.op12_ngram_join,
    "op13_word_trie_resampling": wordtrie.op13_word_trie_resampling,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op2_chat_format": chat.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op4_suffix_dedup": repeats.ORACLE,
    "op6_warc": warc.ORACLE,
    "op9_secret_ledger": secrets.ORACLE,
    "op10_top_k": topk.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_ngram_join": ngramjoin.ORACLE,
    "op13_word_trie_resampling": wordtrie.ORACLE,
}
