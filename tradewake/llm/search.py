"""Ranked lexical search: accumulator-limited, term at a time.

Spark counts the terms of every document that occur in some item, and from that the documents per term, which give the weights. The counted
documents are then searched in blocks of a bounded number of postings. Within a block an item's terms are taken rarest first. Each adds
its scores to accumulators, one per document. The largest score of each remaining term bounds what a document without an accumulator can still
reach; once that falls below the k-th best partial score, no accumulators are created any more, those that can't reach it either are
dropped, and the others are updated exactly. The k best of a block raise the bar for the next blocks of the task. A last step ranks what the tasks found.

Items are dealt into groups of at most ``OCCURRENCES`` term occurrences (or a single item); only one group at a time is sent to the tasks. The
blocks cover all documents, so nothing is left out and results don't depend on how documents are spread.

Defined cases: a null or empty text has no terms; an item without terms, or whose terms no document has, gives no rows; documents of equal score are
ranked by id, null ids last; repeated documents each take a rank; repeated items (same id and text) give one ranking, an id with
several texts one per text; texts may have any length; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewake.llm.common import small_batches, table, texts
from tradewake.session import cut_lineage

BEST = 20
# Term occurrences of the items that are searched together.
OCCURRENCES = 500_000
# Postings of a block.
POSTINGS = 2_000_000
NO_ID = 2**63 - 1

# Letters, digits and all bytes of characters beyond ASCII; lower-casing bytes changes A to Z only.
terms_of = re.compile(rb"[0-9A-Za-z\x80-\xff]+").findall


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (its terms) and the numbers and counts of those terms that have a number; documents without terms are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            ids, sizes, known, times, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                words = terms_of(text.lower())
                if not words:
                    continue
                for word, n in Counter(words).items():
                    at = number(word)
                    if at is not None:
                        known.append(at)
                        times.append(n)
                ids.append(doc_id)
                sizes.append(len(words))
                ends.append(len(known))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32())) for values in (known, times)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    small_batches(docs.sparkSession)
    return texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(count, "doc_id long, n long, terms array<int>, times array<int>")


class Block:
    """Postings of some documents by term, with their score for weight one."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, times: np.ndarray, documents: int, occurrences: int):
        # Documents in order of their ids, so that the smaller index wins ties.
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        rows = np.repeat(place, lengths)
        m = 100 - 25 + (25 * n * documents) // max(occurrences, 1)
        times = times.astype(np.int64)
        value = (1_000_000_000 * times) // (1000 * times + 12 * np.repeat(m, lengths))
        by_term = np.lexsort((rows, terms))
        self.rows, self.value = rows[by_term], value[by_term]
        found, starts = np.unique(terms[by_term], return_index=True)
        self.spans = dict(zip(found.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(terms)])))
        most = np.maximum.reduceat(self.value, starts) if len(starts) else []
        self.most = dict(zip(found.tolist(), map(int, most)))
        self.partial = np.zeros(len(ids), np.int64)

    def best(self, weights: list[tuple[int, int]], k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best documents for terms given as (term, weight), rarest first; those below the bar may be missing."""
        here = [(t, w) for t, w in weights if t in self.spans]
        left = sum(w * self.most[t] for t, w in here)
        partial, touched, at = self.partial, np.zeros(0, np.int64), 0
        for t, w in here:
            if len(touched) >= k:
                bar = max(bar, int(np.partition(partial[touched], -k)[-k]))
            # A document that has nothing yet could at most tie with equality.
            if left < bar:
                break
            start, end = self.spans[t]
            rows = self.rows[start:end]
            fresh = rows[partial[rows] == 0]
            partial[rows] += w * self.value[start:end]
            touched = np.concatenate([touched, fresh])
            left -= w * self.most[t]
            at += 1
        alive = np.sort(touched)
        for t, w in here[at:]:
            alive = alive[partial[alive] + left >= bar]
            start, end = self.spans[t]
            rows = self.rows[start:end]
            where = np.searchsorted(rows, alive)
            where[where == len(rows)] = 0
            hit = rows[where] == alive
            partial[alive[hit]] += w * self.value[start:end][where[hit]]
            left -= w * self.most[t]
        alive = alive[(partial[alive] >= bar) & (partial[alive] > 0)]
        top = alive[np.lexsort((alive, -partial[alive]))[:k]]
        found = self.ids[top], partial[top].copy()
        partial[touched] = 0
        return found


def searched(postings: DataFrame, items: list[tuple[int, list[tuple[int, int]]]], documents: int, occurrences: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each task for each item, given as (number, weights of its terms)."""
    shared = postings.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def run(parts: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(parts)
            lists = whole["terms"].combine_chunks()
            block = Block(
                whole["doc_id"].fill_null(NO_ID).to_numpy(), whole["n"].to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
                lists.flatten().to_numpy(), whole["times"].combine_chunks().flatten().to_numpy(), documents, occurrences,
            )
            for item, weights in shared.value:
                ids, scores = best.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                more = block.best(weights, k, int(scores[k - 1]) if len(scores) >= k else 0)
                ids, scores = np.concatenate([ids, more[0]]), np.concatenate([scores, more[1]])
                first = np.lexsort((ids, -scores))[:k]
                best[item] = ids[first], scores[first]

        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += len(batch["terms"].flatten())
            if held >= POSTINGS:
                run(parts)
                parts, held = [], 0
        if parts:
            run(parts)
        for item, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), item)), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())], ["item", "doc_id", "score"]
            )

    return postings.mapInArrow(search, "item long, doc_id long, score long")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def group_search(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """item_id, rank, doc_id and score for one group of items, rows of (item_id, terms)."""
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    items = []
    for row in rows:
        uses = Counter(numbers.setdefault(t, len(numbers)) for t in terms_of(bytes(row["text"]).lower()))
        items.append((row["item_id"], uses))
    postings = cut_lineage(counted(docs, numbers))
    totals = postings.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences")).first()
    # At most one row per term of the group.
    holding = {r["term"]: r["n"] for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    rarest_first = []
    for number, (_, uses) in enumerate(items):
        weights = sorted((holding[t], t, uses[t] * weight(totals["documents"], holding[t])) for t in uses if t in holding)
        rarest_first.append((number, [(t, w) for _, t, w in weights if w > 0]))
    found = searched(postings, rarest_first, totals["documents"], totals["occurrences"], k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # One row per item of the group.
    names = spark.createDataFrame([(number, item_id) for number, (item_id, _) in enumerate(items)], "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, occurrences: int = OCCURRENCES) -> DataFrame:
    """The k best documents (doc_id, text) for each item (item_id, text): item_id, rank, doc_id, score."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).filter("text IS NOT NULL").distinct()
    # Characters bound the terms from above.
    asked = cut_lineage(asked.withColumn("size", (F.octet_length("text") / 2 + 1).cast("long")))
    total = asked.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-total // occurrences))
    dealt = asked.withColumn("at", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)))
    found = [group_search(docs, dealt.filter(F.col("at") == at).orderBy("item_id", "text").collect(), k) for at in range(groups)]
    return reduce(DataFrame.unionByName, found)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
