"""Matrices derived from the star-schema parquet tables.

Every operand is a lazy DataFrame over ``spark.read.parquet`` so column
pruning and filter push-down reach the scan.  ``l_quantity`` is integer
valued, so all sums below are exact in double precision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def supplier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M_so: supplier x order, summed quantity (duplicates folded).

    Aggregated on the (supplier, order) pair with a map-side partial sum, so
    an order holding a large share of all line items is still spread over
    many tasks; the products' join on the order index then shuffles again,
    where AQE can split a hot order."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_suppkey").alias("i"), F.col("l_orderkey").alias("j"))
              .agg(F.sum("l_quantity").alias("v")))


def supplier_order_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M_raw: supplier x order, one entry per line item (has duplicates)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("i"), F.col("l_orderkey").alias("j"),
                     F.col("l_quantity").cast("double").alias("v"))


def order_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N_on: order x customer nation, value 1 (one entry per order)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .select(F.col("o_orderkey").alias("i"), F.col("c_nationkey").cast("long").alias("j"),
                     F.lit(1.0).alias("v")))


def order_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N_oc: order x customer, value 1."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("j"), F.lit(1.0).alias("v"))


def nation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M_no: supplier nation x order, summed quantity (25 rows: small m)."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (li.join(s, li.l_suppkey == s.s_suppkey)
              .groupBy(F.col("s_nationkey").cast("long").alias("i"), F.col("l_orderkey").alias("j"))
              .agg(F.sum("l_quantity").alias("v")))


def part_supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E_ps: edge list part -> supplier weighted by quantity.  Part and
    supplier ids overlap, so some edges are self-loops."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"),
                     F.col("l_quantity").cast("double").alias("w"))


def embedding_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X_emb: vector x position, value round(e * 1000) so sums are exact."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "e")).select(
        "i", F.col("j").cast("long").alias("j"),
        F.round(F.col("e").cast("double") * 1000).cast("long").cast("double").alias("v"))
