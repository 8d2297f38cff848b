"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has a bit set where over half the hashes of the text's word triples have it
set. Fingerprints at most two bits apart are linked; documents linked over any path form a
group. Everything after the fingerprints works on distinct ones, so exact copies cost one
row in a map-side combined count.

Search: a fingerprint is two segments of 32 bits. Of two fingerprints within
two bits, either the first segments are at most one bit apart or the second ones are equal. So
the table of first segments is asked for the ball of radius one around a first segment, that
of second segments for the segment itself, and the complete distance of what is found there is
verified. Balls are taken upwards only (a zero bit becomes one), so each pair is
met once.

Where more than ``BUCKET`` different fingerprints share a segment, fetching the bucket for each of
its members would be quadratic. Those fingerprints are looked up by the ball of radius one around
the whole fingerprint instead: two fingerprints are within two bits exactly when their
balls share a point, and a point lies in at most 65 balls. The links found this way join the same groups.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; shorter
texts are one shingle; equal rows give equal rows; a null doc_id never names a group
unless all its members are null; no documents, no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm.common import small_batches, table, texts
from tradewake.llm.components import components
from tradewake.session import cut_lineage

SHINGLE = 3
SEED = 42
DISTANCE = 2
BUCKET = 64
HALF = 0xFFFFFFFF


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of an UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        hashes = [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())]
    values = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 1 << 16):
        bits = np.unpackbits(values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print): the fingerprint of each whole text as a signed long."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch["text"]], dtype="<u8").view("<i8")
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "print": found})

    small_batches(docs.sparkSession)
    return texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(scan, "doc_id long, print long")


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column print) whose connected groups are those of distance at most two."""
    first, second = F.shiftrightunsigned("print", 32), F.col("print").bitwiseAND(HALF)

    def entries(part, key):
        return prints.select(F.lit(part).alias("part"), key.alias("key"), "print")

    index = entries(0, first).unionByName(entries(1, second))
    sizes = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    crowded = cut_lineage(sizes.filter(F.col("n") > bucket).drop("n"))
    flipped = prints.select("print", first.alias("segment"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit"))
    flipped = flipped.select("print", "segment", F.expr("shiftleft(1L, bit)").alias("mask")).filter(F.col("segment").bitwiseAND(F.col("mask")) == 0)
    around = flipped.select(F.lit(0).alias("part"), F.col("segment").bitwiseOR(F.col("mask")).alias("key"), "print")
    probes = index.withColumn("exact", F.lit(True)).unionByName(around.withColumn("exact", F.lit(False)))

    table_ = index.join(crowded, ["part", "key"], "left_anti").withColumnRenamed("print", "other")
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("other")))
    found = probes.join(table_, ["part", "key"]).filter((~F.col("exact") | (F.col("print") < F.col("other"))) & (apart <= DISTANCE))
    near = found.select(F.col("print").alias("a"), F.col("other").alias("b"))

    busy = probes.join(crowded, ["part", "key"], "left_semi").select("print").distinct()
    points = busy.select("print", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("bit"))
    points = points.select("print", F.when(F.col("bit") == 64, F.col("print")).otherwise(F.col("print").bitwiseXOR(F.expr("shiftleft(1L, bit)"))).alias("point"))
    # A list of at most 65 fingerprints.
    shared = points.groupBy("point").agg(F.collect_list("print").alias("members")).filter(F.size("members") > 1)
    met = shared.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a <> b")
    return near.unionByName(met).distinct()


def classes(marked: DataFrame) -> DataFrame:
    """(print, first, root): the smallest doc_id and the group of each distinct fingerprint."""
    distinct = cut_lineage(marked.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct))
    named = distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    return cut_lineage(named)


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, print, component_id) for every document."""
    marked = cut_lineage(fingerprints(docs))
    named = classes(marked)
    names = cut_lineage(named.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut_lineage(named.join(names, "root").select("print", "component_id"))
    return marked.join(named, "print")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group stays, with all its columns: a row of its smallest doc_id (null last), if several the first by content.

    Rows are told apart by the place they are written to, as ids may be null or shared. The places that stay go back to the rows as bitmaps,
    one bit a row in groups of at most 32,768 places, so the texts aren't shuffled while those fit a broadcast.
    """

    @F.pandas_udf("long")
    def printed(batch: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in batch], dtype="<u8").view("<i8"))

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("place"))
    rows = cut_lineage(packed.select("doc_id", printed("text").alias("print"), F.xxhash64("_row").alias("content"), "place", "_row"))
    roots = classes(rows.select("doc_id", "print")).select("print", "root")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "content", "place")
    firsts = rows.groupBy("print").agg(F.min(order).alias("first"))
    chosen = firsts.join(roots, "print").groupBy("root").agg(F.min("first").alias("first")).select("first.place")
    # Dealt by group first: a task that met places of all groups would write a bitmap for each.
    chosen = chosen.withColumn("group", F.bitmap_bucket_number("place")).repartition("group")
    staying = cut_lineage(chosen.groupBy("group").agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")))
    at = F.bitmap_bit_position("place").cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    marked = rows.withColumn("group", F.bitmap_bucket_number("place")).join(staying, "group")
    return marked.filter(F.getbit(byte, at % 8) == 1).select("_row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
