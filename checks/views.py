"""Frames over the test tables, each as a DataFrame and as SQL text.

Every frame has row_id, y, protected and its feature columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmend.core import Spec

DOCS = Spec(num=("n_chars", "n_words", "word_len"), cat=("lang", "source"), outlier="n_chars")
ORDERS = Spec(num=("price", "balance"), cat=("status", "segment"), outlier="price")
LINES = Spec(num=("quantity", "price", "discount", "tax"), outlier="price")
EVENTS = Spec(num=("value",), outlier="value")

WORD = "[^ \\t\\n\\r]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    words = F.regexp_count("text", F.lit(WORD))
    d = table(spark, sf, "documents")
    joined = table(spark, sf, "labels").join(d, "doc_id")
    n_chars, n_words = F.col("n_chars").cast("double"), words.cast("double")
    return joined.select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("int").alias("y"),
        (F.col("lang") != "en").alias("protected"),
        n_chars.alias("n_chars"),
        n_words.alias("n_words"),
        F.when(n_words > 0, n_chars / n_words).alias("word_len"),
        "lang",
        "source",
    )


DOCS_SQL = """
SELECT row_id, y, protected, n_chars, n_words,
       CASE WHEN n_words > 0 THEN n_chars / n_words END AS word_len, lang, source
FROM (SELECT l.doc_id AS row_id, CAST(quality AS INT) AS y, lang <> 'en' AS protected,
             CAST(n_chars AS DOUBLE) AS n_chars,
             CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS DOUBLE) AS n_words, lang, source
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


def orders(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("y"),
        (F.col("c_mktsegment") == "HOUSEHOLD").alias("protected"),
        F.col("o_totalprice").alias("price"),
        F.col("c_acctbal").alias("balance"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_mktsegment").alias("segment"),
    )


ORDERS_SQL = """
SELECT o_orderkey AS row_id, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT) AS y,
       c_mktsegment = 'HOUSEHOLD' AS protected, o_totalprice AS price, c_acctbal AS balance,
       o_orderstatus AS status, c_mktsegment AS segment
FROM orders JOIN customer ON o_custkey = c_custkey
"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items have no key: the row id is a hash of the row's content."""
    content = F.concat_ws(
        "|",
        *[F.col(c).cast("bigint").cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint").cast("string"),
        F.unix_date(F.col("l_shipdate").cast("date")).cast("string"),
    )
    row_id = F.conv(F.substring(F.md5(content.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return table(spark, sf, "lineitem").select(
        row_id.alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_linestatus") == "F").alias("protected"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


LINES_SQL = """
SELECT ('0x' || substr(md5(concat_ws('|', l_orderkey::BIGINT, l_linenumber::BIGINT, l_partkey::BIGINT,
        l_suppkey::BIGINT, floor(l_extendedprice * 100 + 0.5::DOUBLE)::BIGINT,
        date_diff('day', DATE '1970-01-01', l_shipdate::DATE))), 1, 15))::BIGINT AS row_id,
       CAST(l_returnflag = 'R' AS INT) AS y, l_linestatus = 'F' AS protected,
       l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax
FROM lineitem
"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        (F.col("user_id") % 3 == 0).alias("protected"),
        F.col("value").alias("value"),
    )


EVENTS_SQL = """
SELECT event_id AS row_id, CAST(event_type = 'error' AS INT) AS y, user_id % 3 = 0 AS protected, value
FROM events
"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        (F.col("label") < 5).cast("int").alias("y"),
        (F.col("vec_id") % 3 == 0).alias("protected"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


VECTORS_SQL = """
SELECT vec_id AS row_id, CAST(label < 5 AS INT) AS y, vec_id % 3 = 0 AS protected,
       CAST(embedding AS DOUBLE[]) AS vec
FROM embeddings
"""
