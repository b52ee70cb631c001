"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from fragmatch.llm import ann, bpe, centroids, embdedup, langid, linededup, minhash, mixing, packing, pii, spelling, substring, urlfilter


def queries() -> dict:
    fns = (
        langid.op1_language_id, bpe.op2_bpe, substring.op3_substring_dedup, ann.op4_ann, pii.op5_pii,
        minhash.op6_minhash, urlfilter.op7_url_filter, embdedup.op8_embedding_dedup, linededup.op9_line_dedup, packing.op10_packing,
        centroids.op11_centroids, mixing.op12_mixing, spelling.op13_spelling,
    )
    return {f.__name__: f for f in fns}


def oracle_sql() -> dict:
    return {"op6_minhash": minhash.OP6_SQL, "op7_url_filter": urlfilter.OP7_SQL, "op8_embedding_dedup": embdedup.OP8_SQL, "op9_line_dedup": linededup.OP9_SQL, "op11_centroids": centroids.OP11_SQL, "op12_mixing": mixing.OP12_SQL}
