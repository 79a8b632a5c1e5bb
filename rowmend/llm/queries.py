"""The operators applied to the test tables, and the SQL each must agree with
where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmend.core import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_mixing(spark, sf):
    from . import mixing

    return mixing.mix(table(spark, sf, "documents"))


@query
def op4_warc(spark, sf):
    from . import warc

    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf, "pages"), path)
    back = warc.fields(warc.read_archive(spark, path))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_simhash(spark, sf):
    from . import simhash

    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op6_quality_rules(spark, sf):
    from . import rules

    judged = rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept", "path")


@query
def op7_license_scan(spark, sf):
    from . import licenses

    return licenses.scan(table(spark, sf, "documents"))


@query
def op8_quality_classifier(spark, sf):
    from . import quality

    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


def _sql() -> dict[str, str]:
    from . import licenses, prefix_trie, spelling

    return {
        "op7_license_scan": licenses.scan_sql(),
        "op11_prefix_trie": prefix_trie.nodes_sql(),
        "op12_spelling_variants": spelling.variants_sql(),
    }


SQL.update(_sql())


@query
def op9_suffix_trees(spark, sf):
    from . import suffix_tree

    cut = suffix_tree.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op10_suffix_array(spark, sf):
    from . import suffix_array

    cut = suffix_array.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op3_decontamination(spark, sf):
    from . import decontaminate

    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op2_language_model(spark, sf):
    from . import lm

    return lm.score(table(spark, sf, "documents"))


@query
def op13_binary_records(spark, sf):
    import public_tokenizers

    from . import records

    done = records.round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op11_prefix_trie(spark, sf):
    from . import prefix_trie

    nodes = prefix_trie.prefix_trie(table(spark, sf, "conversations"))
    return nodes.select(*prefix_trie.NUMBERS, "ends_sha256")


@query
def op12_spelling_variants(spark, sf):
    from . import spelling

    return spelling.spelling_variants(table(spark, sf, "documents"))
