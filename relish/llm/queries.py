"""The registered query of each operator, with production parameters on its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from relish.llm import conversation_trie, filter_audit, jaccard, lm, mixing, nearest, packing, preferences, substring, suffix_dedup, topk, toxicity, url_filter
from relish.llm.registry import ORACLES, QUERIES, query


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)


@query("op2_source_mix", mixing.SQL)
def op2(table):
    mixed = mixing.mix(table("documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


@query("op8_binary_packing")
def op8(table):
    pieces = packing.pack(table("documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op6_url_filter", url_filter.SQL)
def op6(table):
    """Listed besides the rules: the addresses of pages that stem from documents labelled toxic."""
    pages = table("pages").select("page_id", "url")
    source = F.regexp_extract("url", r"^[^:]*://[^/?#]*/[a-z]+/([0-9]+)", 1)
    toxic = table("labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("_doc"))
    host, path = url_filter.host_path(F.col("url"))
    listed = pages.withColumn("_doc", source).join(toxic, "_doc", "left_semi").select(host.alias("host"), path.alias("path"))
    return url_filter.judge(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict")


@query("op1_toxicity")
def op1(table):
    docs = table("documents").select("doc_id", "text")
    model = toxicity.fit_labels(docs, table("labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_multi_index_hashing")
def op10(table):
    return nearest.search(table("embeddings"), lambda id_: id_ % 20 == 0, k=20)


@query("op9_substring_dedup", substring.SQL)
def op9(table):
    kept = substring.remove_repeats(table("documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_prefix_tree_join")
def op7(table):
    return jaccard.similar_components(table("documents"))


@query("op4_subword_lattice")
def op4(table):
    return lm.score(table("documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_preference_pairs", preferences.SQL)
def op3(table):
    formatted = preferences.format_pairs(preferences.reply_pairs(table("conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ")
    return formatted.select("conv_id", "n_common", "prompt", "chosen_text", "rejected_text",
                            spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans"))


@query("op5_block_max_wand")
def op5(table):
    return topk.search(table("documents"), lambda id_: id_ % 100 == 0, k=10)


@query("op11_filter_audit", filter_audit.SQL)
def op11(table):
    return filter_audit.audit(table("documents").select("doc_id", "text", "source"), table("labels"))


@query("op12_conversation_trie", conversation_trie.SQL)
def op12(table):
    return conversation_trie.rebuilt_trie(table("conversations"))


@query("op13_suffix_dedup", suffix_dedup.SQL)
def op13(table):
    kept = suffix_dedup.remove_repeated_bytes(table("documents"), keep=["doc_id"])
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
