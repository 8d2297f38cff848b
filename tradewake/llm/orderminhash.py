"""Document fingerprints by order MinHash, which follow edit distance rather than shared content alone.

A text is a sequence of units: its words, long ones cut into parts. Every group of ``GROUP`` units gets its number of
occurrence so far, so repeats count. Each of ``PARTS`` hash functions selects the ``TAKEN`` smallest
numbered groups; they are put back into the order of the text and hashed together. Two fingerprints agree in a part when
the texts share those groups in that order, so moving text around is seen as well. Likeness is the share of equal parts.

The query compares each document with an edited copy that borrows from the next document. The documents are dealt out
in ranges of doc_id and sorted, so the next document is the next row; only the last row of a range must be
brought together with the first row of the following one, two rows per range.

Defined cases: a null text is empty; texts without words have equal fingerprints; a single document is its own next one;
rows that share a doc_id are ordered by a hash of their text, null ids come first; no documents, no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm.common import small_batches, table
from tradewake.session import cut_lineage

PARTS = 64
TAKEN = 2
GROUP = 2
UNIT_CHARS = 16
SEED = 7
MEMORY = 500_000
# Hash values held at once.
BLOCK = 1 << 18

STEP = np.uint64(0x9E3779B97F4A7C15)


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprints:
    """Fingerprints of texts; hashes of words are remembered."""

    def __init__(self):
        from xxhash import xxh3_64_intdigest

        self.hash = xxh3_64_intdigest
        self.known: dict[str, int] = {}
        # Odd multipliers: each orders the hashes anew.
        self.orders = np.random.default_rng(SEED).integers(0, 2**63, PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def units(self, text: str) -> np.ndarray:
        words, known = text.split(), self.known
        found = list(map(known.get, words))
        if None in found:
            if len(known) > MEMORY:
                known.clear()
            hashes: list[int] = []
            for word, value in zip(words, found):
                if value is not None:
                    hashes.append(value)
                elif len(word) <= UNIT_CHARS:
                    value = known[word] = self.hash(word.encode("utf-8", "surrogatepass"))
                    hashes.append(value)
                else:
                    hashes += [self.hash(word[i : i + UNIT_CHARS].encode("utf-8", "surrogatepass")) for i in range(0, len(word), UNIT_CHARS)]
            found = hashes
        return np.array(found, dtype=np.uint64)

    def of(self, text: str) -> bytes:
        """PARTS numbers of 16 bits."""
        units = self.units(text)
        if not len(units):
            return bytes(2 * PARTS)
        width = min(GROUP, len(units))
        groups = np.zeros(len(units) - width + 1, np.uint64)
        for j in range(width):
            groups = groups * STEP + units[j : len(units) - width + 1 + j]
        groups = spread(groups)
        order = np.argsort(groups, kind="stable")
        ranked = groups[order]
        starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        number = np.empty(len(groups), np.uint64)
        number[order] = (np.arange(len(groups)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(groups)]))))).astype(np.uint64)
        numbered = spread(groups + number * STEP)
        taken = min(TAKEN, len(groups))
        places = np.empty((PARTS, taken), np.int64)
        rows = max(1, BLOCK // len(groups))
        for at in range(0, PARTS, rows):
            values = numbered[None, :] * self.orders[at : at + rows, None]
            line = np.arange(len(values))
            for t in range(taken):
                places[at : at + rows, t] = least = values.argmin(axis=1)
                values[line, least] = np.uint64(2**64 - 1)
        places.sort(axis=1)
        parts = np.arange(PARTS, dtype=np.uint64)
        for t in range(taken):
            parts = spread(parts * STEP + groups[places[:, t]])
        return (parts & np.uint64(0xFFFF)).astype("<u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return float(np.mean(np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")))


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the beginning of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def compared(prints: Fingerprints, doc_id, text: str, mine: bytes, following: str, theirs: bytes) -> tuple:
    changed = edited(text, following)
    other = mine if changed == text else prints.of(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), mine, other, likeness(mine, other), likeness(mine, theirs)


RESULT = ("doc_id", "n_chars", "sha", "print", "edited_print", "near_edited", "near_next")
RESULT_TYPES = "doc_id long, n_chars long, sha binary, print binary, edited_print binary, near_edited double, near_next double"


def in_ranges(rows: DataFrame) -> DataFrame:
    """Finished rows (kind 0) and, of every range, its last document (kind 1) and its first (kind 2) with their texts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prints, part, before = Fingerprints(), TaskContext.get().partitionId(), None
        names = ["kind", "part", "text", *RESULT]
        blank = (None,) * 6
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                mine = prints.of(text)
                if before is None:
                    out.append((2, part, text, doc_id, *blank))
                else:
                    out.append((0, part, None, *compared(prints, *before, text, mine)))
                before = (doc_id, text, mine)
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64", "n_chars": "Int64"})
        if before is not None:
            last = [(1, part, before[1], before[0], *blank)]
            yield pd.DataFrame(last, columns=names).astype({"doc_id": "Int64", "n_chars": "Int64"})

    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return cut_lineage(dealt.select("doc_id", "text").mapInPandas(scan, f"kind int, part int, text string, {RESULT_TYPES}"))


def at_borders(stage: DataFrame) -> DataFrame:
    """Results for the last document of every range."""
    spark = stage.sparkSession
    # One number per range.
    parts = sorted(r["part"] for r in stage.filter("kind = 2").select("part").collect())
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    lasts = stage.filter("kind = 1").select("part", "doc_id", "text").join(F.broadcast(following), "part")
    firsts = stage.filter("kind = 2").select(F.col("part").alias("after"), F.col("text").alias("next_text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prints = Fingerprints()
        for batch in batches:
            out = [compared(prints, i, a, prints.of(a), b, prints.of(b)) for i, a, b in zip(batch["doc_id"].astype("Int64"), batch["text"], batch["next_text"])]
            yield pd.DataFrame(out, columns=list(RESULT)).astype({"doc_id": "Int64"})

    return lasts.join(firsts, "after").select("doc_id", "text", "next_text").mapInPandas(scan, RESULT_TYPES)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness to each other and to the next document's."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    stage = in_ranges(rows)
    every = stage.filter("kind = 0").select(*RESULT).unionByName(at_borders(stage))
    return every.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op6_orderminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
