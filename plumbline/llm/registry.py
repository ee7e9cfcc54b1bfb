"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from plumbline.llm import bpe, chat, fingerprints, html, jaccard, packing, quality, secrets, topk, warc
from plumbline.llm.common import importable

_QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_warc": warc.op2_warc,
    "op3_packing": packing.op3_packing,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_html_extraction": html.op5_html_extraction,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_secret_scans": secrets.op9_secret_scans,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
}


def _ready(query):
    def run(spark, sf_dir):
        importable(spark)
        return query(spark, sf_dir)

    return run


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {name: _ready(q) for name, q in {**_QUERIES, "pipeline": pipeline}.items()}


def oracle_sql():
    return {"op1_chat_formatting": chat.OP1_SQL, "op2_warc": warc.OP2_SQL, "op7_exact_topk": topk.OP7_SQL, "op10_ngram_jaccard": jaccard.OP10_SQL}
