"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, decontam, exact, lines, minhash, pieces, quality, ranked, secrets, sst, toxicity, trie

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_chat": chat.op4_chat,
    "op5_sst": sst.op5_sst,
    "op6_minhash": minhash.op6_minhash,
    "op7_pieces": pieces.op7_pieces,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_secrets": secrets.op10_secrets,
    "op11_trie": trie.op11_trie,
    "op12_search": ranked.op12_search,
    "op13_bpe": bpe.op13_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat": chat.ORACLE_SQL,
    "op8_exact_dedup": exact.ORACLE_SQL,
    "op9_decontamination": decontam.ORACLE_SQL,
    "op10_secrets": secrets.ORACLE_SQL,
    "op11_trie": trie.ORACLE_SQL,
    "op12_search": ranked.ORACLE_SQL,
}
