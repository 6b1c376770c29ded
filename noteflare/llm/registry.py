"""Registered queries of the corpus operators: thin, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteflare.llm import (
    ann,
    chat_rotation,
    conversation_repair,
    decontaminate,
    html_extract,
    license_scan,
    line_dedup,
    mixing,
    simhash,
    suffix_dedup,
    toxicity,
    url_filter,
    vector_codes,
)
from noteflare.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return wrap


@register("op1_ann")
def op1_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@register("op2_suffix_dedup")
def op2_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op3_decontaminate", decontaminate.ORACLE_SQL)
def op3_decontaminate(spark, sf_dir):
    return decontaminate.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op4_license_scan")
def op4_license_scan(spark, sf_dir):
    out = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("text")


@register("op5_url_filter")
def op5_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@register("op6_chat_rotation", chat_rotation.ORACLE_SQL)
def op6_chat_rotation(spark, sf_dir):
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


@register("op7_html_extract")
def op7_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@register("op8_simhash")
def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op9_mixing", mixing.oracle_sql())
def op9_mixing(spark, sf_dir):
    out = mixing.in_order(mixing.mix(table(spark, sf_dir, "documents"), keep=()))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position")


@register("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@register("op13_line_dedup", line_dedup.ORACLE_SQL)
def op13_line_dedup(spark, sf_dir):
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op12_vector_codes", vector_codes.oracle_sql())
def op12_vector_codes(spark, sf_dir):
    out = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@register("op11_conversation_repair", conversation_repair.ORACLE_SQL)
def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")), present_col="present")
