"""Removal of repeated passages: words covered by a window of words that also starts earlier in the corpus.

The method streams documents through suffix automata of reference shards. Two steps before it keep that
affordable, so that no document meets a shard it shares nothing with:

* Every window is named after its anchor, the smallest hash among its word groups. Equal windows have equal
  anchors, so an anchor that occurs once in the corpus settles all its windows. Consecutive windows of
  one anchor form a segment.
* Of equal segments all but the first are repeated as a whole, which takes a count and no text.

What remains are different segments with one anchor: edited copies and the edges of passages. The segments of
an anchor are a reference shard. In the order of the corpus each is added to the shard's automaton and streamed
through it; the matching statistics give, at every word, the longest match that ends there and where its last words
ended first. Windows that did so earlier are repeated. Anchors with more than ``CROWD`` such segments
(the edge of a passage that very many documents share) have their windows counted by content instead,
with map-side combining, which gives the same answer without gathering them.

Hashes are 64 bits for anchors and 128 for segments and windows. Text is shuffled once, and again only for
documents with segments for the automata.

Rows are told apart by doc_id and a hash of the text, and ordered by doc_id alone.

Defined cases: a null text has no words; white space is ASCII white space; rows that share a doc_id are no earlier than
one another, whether their texts differ or not; null doc_ids are one doc_id, which sorts before all others; texts shorter than a window are kept whole; no
documents, no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm.common import row_key, small_batches, table
from tradewake.session import cut_lineage

WINDOW = 20
# Words of the groups whose hashes are compared for the anchor.
GROUP = 5
# Windows of a segment at most.
LONGEST = WINDOW - GROUP + 1
# Different segments of one anchor from which windows are counted instead.
CROWD = 1000
# Words that are hashed together.
BLOCK_WORDS = 1 << 16

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base))))


class Words:
    """Hashes of words and of runs of words."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """A hash per word, from the bytes of many words at once."""
        parts = [np.zeros(0, np.uint64)]
        for at in range(0, len(words), BLOCK_WORDS):
            # Words hold no blanks, so each ends at one.
            letters = np.frombuffer(b" ".join(words[at : at + BLOCK_WORDS]), np.uint8)
            ends = np.append(np.flatnonzero(letters == 32), len(letters))
            starts = np.append(0, ends[:-1] + 1)
            parts.append(self.spans(letters.astype(np.uint64) + np.uint64(1), starts, ends))
        return np.concatenate(parts)

    def spans(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of hashes[start:end] for each pair."""
        n = len(hashes)
        if len(self.up) <= n:
            self.up, self.down = powers(MULTIPLIER, n + n // 4), powers(INVERSE, n + n // 4)
        before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * self.up[:n])))
        return mixed((before[ends] - before[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


class Segments:
    """Segments of one document: start and number of windows, anchor, content hash; which repeat themselves or an earlier one."""

    def __init__(self, words: Words, text: list[bytes]):
        n = len(text)
        if n < WINDOW:
            self.start = self.count = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.uint64)
            self.inner = self.again = np.zeros(0, bool)
            return
        hashes = words.hashes(text)
        groups = np.zeros(n - GROUP + 1, np.uint64)
        for j in range(GROUP):
            groups = groups * MULTIPLIER + hashes[j : n - GROUP + 1 + j]
        groups = mixed(groups)
        least = groups
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:])
        runs = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        lengths = np.diff(np.concatenate((runs, [len(least)])))
        parts = -(-lengths // LONGEST)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        self.start = np.repeat(runs, parts) + LONGEST * (np.arange(parts.sum()) - first)
        self.count = np.diff(np.concatenate((self.start, [len(least)])))
        self.anchor = least[self.start]
        self.content = words.spans(hashes, self.start, self.start + self.count + WINDOW - 1)
        self.inner = np.zeros(len(self.start), bool)
        self.again = np.zeros(len(self.start), bool)
        values, times = np.unique(groups, return_counts=True)
        twice = set(values[times > 1].tolist())
        if twice:
            seen = set()
            for i, anchor in enumerate(self.anchor.tolist()):
                if anchor in twice:
                    span = groups[self.start[i] : self.start[i] + self.count[i] + LONGEST - 1]
                    self.inner[i] = np.count_nonzero(span == self.anchor[i]) > 1
                    key = (anchor, int(self.content[i]))
                    self.again[i] = key in seen
                    seen.add(key)


class Automaton:
    """Suffix automaton of word sequences; each state knows where its strings first ended."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first: list[tuple] = [()]
        self.last = 0

    def _state(self, length: int, link: int, moves: dict, first: tuple) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _branch(self, p: int, c, q: int) -> int:
        """A copy of q for the strings that p continues to with c."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, c, place: tuple) -> None:
        p = self.last
        q = self.next[p].get(c)
        if q is not None:
            # Already known from an earlier sequence.
            self.last = q if self.length[q] == self.length[p] + 1 else self._branch(p, c, q)
            return
        new = self._state(self.length[p] + 1, 0, {}, place)
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._branch(p, c, q)
        self.last = new

    def add_sequence(self, words: list, places: list[tuple]) -> None:
        self.last = 0
        for word, place in zip(words, places):
            self.add(word, place)

    def matches(self, words: list) -> Iterator[tuple[int, int]]:
        """Matching statistics: at each word the longest match that ends there, as (length, state)."""
        state, long = 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                long = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                long += 1
            else:
                state, long = 0, 0
            yield long, state

    def first_place(self, state: int, length: int) -> tuple:
        """Where the last ``length`` words of the match first ended."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return self.first[state]


def repeated_in_shard(segments: list[tuple[int, int, int, list]]) -> list[tuple[int, int, int]]:
    """(doc_id, row, start) of windows that start earlier too, among segments (doc_id, row, start, words) in corpus order."""
    automaton, found = Automaton(), []
    for doc_id, group in groupby(segments, key=lambda s: s[0]):
        rows = [list(r) for _, r in groupby(group, key=lambda s: s[1])]
        for parts in rows:
            # Rows of one doc_id don't see each other: each has its own places, beside those of smaller ids.
            own = automaton if len(rows) == 1 else Automaton()
            for _, row, start, words in parts:
                earlier = [long >= WINDOW for long, _ in automaton.matches(words)] if len(rows) > 1 else [False] * len(words)
                own.add_sequence(words, [(doc_id, start + i) for i in range(len(words))])
                for i, (long, state) in enumerate(own.matches(words)):
                    # It matches itself; what matters is where the last words of the match ended first.
                    if earlier[i] or (long >= WINDOW and own.first_place(state, WINDOW) < (doc_id, start + i)):
                        found.append((doc_id, row, start + i - WINDOW + 1))
        if len(rows) > 1:
            for _, _, start, words in (s for parts in rows for s in parts):
                automaton.add_sequence(words, [(doc_id, start + i) for i in range(len(words))])
    return found


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): ids and a hash of the text tell rows apart."""
    rows = docs.select(row_key(F.col("doc_id")).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("row"), "text")


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def occurrences(rows: DataFrame) -> DataFrame:
    """(anchor, content, doc_id, row, start, inner): first use of every segment in each document."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            parts = []
            for doc_id, row, text in zip(batch["doc_id"], batch["row"], batch["text"]):
                s = Segments(words, text.split())
                keep = ~s.again
                parts.append((signed(s.anchor[keep]), signed(s.content[keep]), np.full(keep.sum(), doc_id), np.full(keep.sum(), row), s.start[keep], s.inner[keep]))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts)]
                yield pd.DataFrame(dict(zip(("anchor", "content", "doc_id", "row", "start", "inner"), columns)))

    return rows.mapInPandas(scan, "anchor long, content long, doc_id long, row long, start int, inner boolean")


def shared_segments(rows: DataFrame) -> DataFrame:
    """(doc_id, row, start, anchor, whole): segments whose anchor occurs again; whole if all its windows start earlier, else they are to be looked at."""
    uses = occurrences(rows)
    anchors = uses.groupBy("anchor").agg(
        F.count("*").alias("uses"), F.min("content").alias("low"), F.max("content").alias("high"), F.min("doc_id").alias("first"), F.max("inner").alias("any_inner")
    )
    anchors = cut_lineage(anchors.filter("uses > 1 OR any_inner").select("anchor", "first", (F.col("low") != F.col("high")).alias("various")))
    # Counted above in one pass and met again in a second: reading twice costs less than keeping every segment.
    met = cut_lineage(uses.join(anchors, "anchor"))
    alike = met.filter("NOT various").select("doc_id", "row", "start", "anchor", "inner", "first")
    various = met.filter("various").drop("first")
    firsts = cut_lineage(various.groupBy("anchor", "content").agg(F.min("doc_id").alias("first")))
    differing = various.join(firsts, ["anchor", "content"]).withColumn("inner", F.lit(True)).select("doc_id", "row", "start", "anchor", "inner", "first")
    every = alike.unionByName(differing).withColumn("whole", F.col("doc_id") > F.col("first"))
    return every.filter("whole OR inner").select("doc_id", "row", "start", "anchor", "whole")


def finish(words: list[bytes], windows: np.ndarray) -> tuple[int, int, str]:
    """n_words, n_removed, kept_sha256 from a mark per window."""
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(windows)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    removed = np.cumsum(edges)[:-1] > 0
    kept = [w for w, gone in zip(words, removed.tolist()) if not gone] if len(at) else words
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def marked(words: Words, text: list[bytes], whole: list[int]) -> tuple[Segments, np.ndarray]:
    """Marks of the windows of segments that repeat as a whole."""
    segments = Segments(words, text)
    marks = np.zeros(max(len(text) - WINDOW + 1, 0), bool)
    known = set(whole)
    for i in range(len(segments.start)):
        start = int(segments.start[i])
        if segments.again[i] or start in known:
            marks[start : start + int(segments.count[i])] = True
    return segments, marks


def first_pass(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Documents that are settled (kind 0), those that aren't with their marks (1), and their open segments (2)."""
    # Copies of a row under one doc_id bring equal entries.
    lists = shared.groupBy("doc_id", "row").agg(
        F.collect_set(F.when(F.col("whole"), F.col("start"))).alias("whole"),
        F.collect_set(F.when(~F.col("whole"), F.struct("start", "anchor"))).alias("open"),
    )
    both = rows.join(cut_lineage(lists), ["doc_id", "row"], "left")
    both = both.select("doc_id", "row", "text", "whole", F.col("open.start").alias("open"), F.col("open.anchor").alias("anchors"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Words()
        for batch in batches:
            out = []
            for doc_id, row, text, whole, opened, anchors in zip(batch["doc_id"], batch["row"], batch["text"], batch["whole"], batch["open"], batch["anchors"]):
                words = text.split()
                if whole is None and len(words) < WINDOW:
                    out.append((0, doc_id, row, None, None, None, None, *finish(words, np.zeros(0, bool))))
                    continue
                segments, marks = marked(hashes, words, [] if whole is None else list(whole))
                if opened is None or not len(opened):
                    out.append((0, doc_id, row, None, None, None, None, *finish(words, marks)))
                    continue
                counts = dict(zip(segments.start.tolist(), segments.count.tolist()))
                out.append((1, doc_id, row, b" ".join(words), None, None, np.packbits(marks).tobytes(), None, None, None))
                for start, anchor in zip(opened, anchors):
                    part = words[start : start + counts[int(start)] + WINDOW - 1]
                    out.append((2, doc_id, row, b" ".join(part), start, anchor, None, None, None, None))
            yield pd.DataFrame(out, columns=["kind", "doc_id", "row", "text", "start", "anchor", "marks", "n_words", "n_removed", "kept_sha256"]).astype({c: "Int64" for c in ("start", "anchor", "n_words", "n_removed")})

    schema = "kind int, doc_id long, row long, text binary, start long, anchor long, marks binary, n_words long, n_removed long, kept_sha256 string"
    return cut_lineage(both.mapInPandas(scan, schema))


def repeated_windows(open_segments: DataFrame) -> DataFrame:
    """(doc_id, row, start) of the windows of open segments that start earlier too."""
    parts = open_segments.select("anchor", "doc_id", "row", "start", "text")
    sizes = cut_lineage(parts.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD))
    calm = parts.join(sizes, "anchor", "left_anti")
    crowded = parts.join(sizes, "anchor", "left_semi")

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by anchor, then in corpus order."""
        anchor, held = None, []
        for batch in batches:
            found = []
            for key, doc_id, row, start, text in zip(batch["anchor"], batch["doc_id"], batch["row"], batch["start"], batch["text"]):
                if key != anchor:
                    found += repeated_in_shard(held)
                    anchor, held = key, []
                held.append((doc_id, row, start, text.split(b" ")))
            yield pd.DataFrame(found, columns=["doc_id", "row", "start"])
        yield pd.DataFrame(repeated_in_shard(held), columns=["doc_id", "row", "start"])

    dealt = calm.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "row", "start")
    by_automaton = dealt.mapInPandas(shards, "doc_id long, row long, start long")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Words()
        for batch in batches:
            out = []
            for doc_id, row, start, text in zip(batch["doc_id"], batch["row"], batch["start"], batch["text"]):
                words = text.split(b" ")
                at = np.arange(len(words) - WINDOW + 1)
                values = hashes.hashes(words)
                first, second = hashes.spans(values, at, at + WINDOW), hashes.spans(mixed(values), at, at + WINDOW)
                out.append((signed(first), signed(second), np.full(len(at), doc_id), np.full(len(at), row), start + at))
            if out:
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pd.DataFrame(dict(zip(("a", "b", "doc_id", "row", "start"), columns)))

    each = crowded.mapInPandas(windows, "a long, b long, doc_id long, row long, start long")
    # The first document of each window, then the first start there.
    firsts = cut_lineage(each.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    met = each.join(firsts, ["a", "b"])
    again = met.filter("doc_id > first").select("doc_id", "row", "start")
    own = met.filter("doc_id = first").groupBy("a", "b", "doc_id", "row").agg(F.min("start").alias("low"), F.collect_set("start").alias("starts"))
    own = own.filter(F.size("starts") > 1).select("doc_id", "row", F.explode("starts").alias("start"), "low").filter("start > low").drop("low")
    return by_automaton.unionByName(again).unionByName(own)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    small_batches(docs.sparkSession)
    rows = rows_of(docs)
    stage = first_pass(rows, shared_segments(rows))
    settled = stage.filter("kind = 0").select("doc_id", "n_words", "n_removed", "kept_sha256")
    more = repeated_windows(stage.filter("kind = 2")).groupBy("doc_id", "row").agg(F.collect_set("start").alias("starts"))
    unsettled = stage.filter("kind = 1").select("doc_id", "row", "text", "marks").join(cut_lineage(more), ["doc_id", "row"], "left")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, marks, starts in zip(batch["doc_id"], batch["text"], batch["marks"], batch["starts"]):
                words = text.split(b" ")
                windows = np.unpackbits(np.frombuffer(marks, np.uint8), count=len(words) - WINDOW + 1).astype(bool)
                if starts is not None:
                    windows[np.asarray(starts, dtype=np.int64)] = True
                out.append((doc_id, *finish(words, windows)))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rest = unsettled.mapInPandas(scan, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    every = settled.unionByName(rest)
    return every.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
