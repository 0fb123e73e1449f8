"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from . import chat, codec, embeddings, licenses, lines, minhash, mixing, quality, repeats, token_counts

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_chat_format": chat.op2_chat_format,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_embeddings": embeddings.op4_embeddings,
    "op5_bpe_round_trip": codec.op5_bpe_round_trip,
    "op6_minhash": minhash.op6_minhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_repeats": repeats.op10_repeats,
}

ORACLES = {
    "op2_chat_format": chat.OP2_SQL,
    "op4_embeddings": embeddings.OP4_SQL,
    "op6_minhash": minhash.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_license_scan": licenses.OP9_SQL,
}
