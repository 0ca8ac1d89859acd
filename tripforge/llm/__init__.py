"""Operations of a training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations


def queries() -> dict:
    """The numbered queries, by name."""
    from . import bpe, conversations, decontaminate, html_extract, langid, pieces, quality, secrets, sharding, simhash, substring, warc, whitening

    found = [
        decontaminate.op1_decontamination, quality.op2_quality_rules, secrets.op3_secret_scan, bpe.op4_bpe, langid.op5_language_id,
        warc.op6_warc_revisits, simhash.op7_simhash, html_extract.op8_html_text, sharding.op9_sharding, substring.op10_substring_dedup,
        pieces.op11_sentencepiece, whitening.op12_embedding_whitening, conversations.op13_conversation_repair,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    """DuckDB SQL for the queries that SQL can express."""
    from . import quality, secrets, substring, warc

    return {"op2_quality_rules": quality.SQL, "op3_secret_scan": secrets.SQL, "op6_warc_revisits": warc.SQL, "op10_substring_dedup": substring.SQL}
