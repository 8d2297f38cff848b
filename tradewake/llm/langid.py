"""Language identification with unigram piece models, summed over all segmentations.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is
the sum over all ways to cut it into pieces of the product of their probabilities, which the forward
algorithm gives in one pass; that of a text is the product over its words. Words are maximal runs of
letters, lower-cased; other characters carry no evidence.

Training: ``TRAIN_DOCS`` documents per language at most, chosen by hash among the labelled ones of the training
part, whole texts. Their words are counted by Spark; expectation maximisation then runs over the distinct words,
each round being one pass and one sum per language and piece. The model has one row per piece of the vocabulary.

Defined cases: ``und`` with score 0 where the text is null or has no letter; with nothing to learn from, every
prediction is ``und``; rows are judged one by one; ties go to the alphabetically first language; no documents,
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewake.llm.common import sample_per_class, small_batches, table
from tradewake.session import cut_lineage

UNKNOWN = "und"
FOLDS, HELD_OUT_FOLD = 4, 2
# Labelled documents per language that the models are fitted on.
TRAIN_DOCS = 800
ROUNDS = 2
# Longest piece in letters, and longest run of letters that is scored in one go.
LONGEST = 12
RUN = 32
START = "▁"
# Share of the counts over all languages mixed into each language's.
SHARED = 0.01
# Probability of a letter outside the vocabulary.
RARE = 1e-8
# Words and runs of letters whose scores a Python worker keeps, some 80 MB with four languages, and the words that are read at a time.
MEMORY = 600_000
AT_ONCE = 500_000
# Below this certainty the pipeline drops a document.
ACCEPT = 0.35

letters = re.compile(r"[^\W\d_]+").findall


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[str]:
    """Pieces made of letters only, lower-cased, some of them marked as starting a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if len(p) <= LONGEST and (p == START or p.removeprefix(START).isalpha()))


def runs(text: str) -> list[str]:
    """Lower-cased runs of letters, long ones cut every RUN letters."""
    return [w[i : i + RUN] for w in letters(text.lower()) for i in range(0, len(w), RUN)]


class Forward:
    """Sums over all segmentations of a word, for expected uses of pieces."""

    def __init__(self, model: dict[str, list[float]], languages: int):
        self.model = model
        self.rare = [RARE] * languages
        self.zero = [0.0] * languages

    def arcs(self, word: str):
        """(start, end, piece, probabilities) in order of start; letters without a piece count as rare."""
        n, get = len(word), self.model.get
        for i in range(n):
            single = word[i : i + 1]
            yield i, i + 1, single, get(single) or self.rare
            for j in range(i + 2, min(n, i + LONGEST) + 1):
                p = get(word[i:j])
                if p is not None:
                    yield i, j, word[i:j], p

    def alphas(self, word: str) -> list[list[float]]:
        sums = [self.zero[:] for _ in range(len(word) + 1)]
        sums[0] = [1.0] * len(self.zero)
        for i, j, _, p in self.arcs(word):
            at, to = sums[i], sums[j]
            for k, q in enumerate(p):
                to[k] += at[k] * q
        return sums

    def expected(self, word: str, k: int) -> list[tuple[str, float]]:
        """Pieces of the word with their expected uses in language number k."""
        marked = START + word
        forward = [a[k] for a in self.alphas(marked)]
        if not forward[-1] > 0:
            return []
        found, backward = [], [0.0] * len(forward)
        backward[-1] = 1.0
        for i, j, piece, p in sorted(self.arcs(marked), key=lambda a: -a[0]):
            backward[i] += p[k] * backward[j]
            found.append((piece, forward[i] * p[k] * backward[j] / forward[-1]))
        return found


def fold(column, folds: int):
    return F.coalesce(F.crc32(column.cast("string")) % folds, F.lit(-1))


def training_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, lang) of the documents to learn from, at most TRAIN_DOCS per language."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT_FOLD))
    return sample_per_class(labelled, "lang", "doc_id", TRAIN_DOCS)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over the training documents."""
    chosen = cut_lineage(training_rows(docs).select("doc_id").distinct())
    # At most TRAIN_DOCS rows per language.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL").join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch["lang"], batch["text"]):
                counts.update((lang, w) for w in runs(text))
            yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["lang", "word", "n"])

    return rows.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def normalised(counts: pd.DataFrame, languages: list[str]) -> dict[str, list[float]]:
    """Piece probabilities per language from (lang, piece, n)."""
    wide = counts.pivot_table(index="piece", columns="lang", values="n", aggfunc="sum").reindex(columns=languages).fillna(0.0)
    table_ = wide.to_numpy(dtype=float)
    everywhere = table_.sum(axis=1, keepdims=True) + 1e-3
    totals = table_.sum(axis=0, keepdims=True) + 1e-9
    mixed = (1 - SHARED) * table_ / totals + SHARED * everywhere / everywhere.sum()
    return dict(zip(wide.index, np.maximum(mixed, RARE).tolist()))


class LanguageModel:
    """Piece probabilities of each language, and how common the languages are."""

    def __init__(self, languages: list[str], priors: list[float], pieces: dict[str, list[float]]):
        self.name = uuid.uuid4().hex
        self.languages, self.priors, self.pieces = languages, priors, pieces


def train(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> LanguageModel:
    spark = docs.sparkSession
    small_batches(spark)
    words = cut_lineage(word_counts(docs))
    shares = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(shares)
    if not languages:
        return LanguageModel([], [], {})
    pieces = vocabulary(path or vocabulary_path())
    model = {p: [1.0 / len(pieces)] * len(languages) for p in pieces}
    number = {lang: k for k, lang in enumerate(languages)}
    ordered = words.sortWithinPartitions("lang")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            at, one = None, None
            for batch in batches:
                sums: dict[tuple[str, str], float] = {}
                for lang, group in batch.groupby("lang"):
                    if lang != at:
                        at, one = lang, Forward({p: [v[number[lang]]] for p, v in shared.value.items()}, 1)
                    for word, n in zip(group["word"], group["n"]):
                        for piece, uses in one.expected(word, 0):
                            sums[lang, piece] = sums.get((lang, piece), 0.0) + n * uses
                yield pd.DataFrame([(a, b, n) for (a, b), n in sums.items()], columns=["lang", "piece", "n"])

        # In order of language, so that a task builds the model of each language once and holds one at a time.
        counts = ordered.mapInPandas(expect, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        # At most one row per language and piece of the vocabulary, or single letter.
        model = normalised(counts.toPandas(), languages)
    total = sum(shares.values())
    return LanguageModel(languages, [math.log(shares[x] / total) for x in languages], model)


class WordScores:
    """Rows of per-language scores, remembered per word as it stands in the text."""

    def __init__(self, model: LanguageModel):
        self.name, self.languages = model.name, model.languages
        self.priors = np.array(model.priors)
        # Row 0 is for strings that are no piece, row 1 for letters outside the vocabulary.
        self.number = {piece: i + 2 for i, piece in enumerate(model.pieces)}
        width = len(self.languages)
        self.pieces = np.array([[0.0] * width, [RARE] * width, *model.pieces.values()]).reshape(-1, width)
        # Rows of words as they stand in texts, and of runs of letters: words that differ in case or punctuation share a row.
        self.known: dict[bytes, int] = {}
        self.runs: dict[str, int] = {}
        # Row 0 is for words without letters.
        self.table = np.zeros((1024, width + 1))
        self.used = 1

    def forget(self) -> None:
        """Drops what was learned in the later half; the common words are met early."""
        self.used = 1 + self.used // 2
        self.known = {w: i for w, i in self.known.items() if i < self.used}
        self.runs = {r: i for r, i in self.runs.items() if i < self.used}
        if len(self.known) + len(self.runs) > MEMORY // 2:
            self.known, self.runs, self.used = {}, {}, 1

    def score(self, words: list[str]) -> np.ndarray:
        """Log-probability per language of words of one length: the forward sums of all of them at once."""
        marked = [START + w for w in words]
        n, get = len(marked[0]), self.number.get
        arcs = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + LONGEST) + 1)]
        numbers = np.array([[get(w[i:j]) or int(j == i + 1) for i, j in arcs] for w in marked])
        sums = np.zeros((n + 1, len(words), len(self.languages)))
        sums[0] = 1.0
        for k, (i, j) in enumerate(arcs):
            sums[j] += sums[i] * self.pieces[numbers[:, k]]
        return np.log(np.maximum(sums[n], 1e-300))

    def learn(self, words: set[bytes]) -> None:
        """Remembers the scores of these words, at most AT_ONCE."""
        split = {w: runs(w.decode("utf-8", "replace")) for w in words - self.known.keys()}
        # A word takes a row at most, and each of its runs.
        if len(self.known) + len(self.runs) + len(split) + sum(map(len, split.values())) > MEMORY:
            self.forget()
            split = {w: runs(w.decode("utf-8", "replace")) for w in words - self.known.keys()}
        grouped: dict[int, list[str]] = {}
        for run in {r for parts in split.values() for r in parts} - self.runs.keys():
            grouped.setdefault(len(run), []).append(run)
        for length, group in grouped.items():
            for start in range(0, len(group), 4096):
                some = group[start : start + 4096]
                self._make_room(len(some))
                self.table[self.used : self.used + len(some), :-1] = self.score(some)
                self.table[self.used : self.used + len(some), -1] = length
                self.runs.update(zip(some, range(self.used, self.used + len(some))))
                self.used += len(some)
        for word, parts in split.items():
            if len(parts) > 1:
                self._make_room(1)
                self.table[self.used] = self.table[[self.runs[p] for p in parts]].sum(axis=0)
                self.known[word] = self.used
                self.used += 1
            else:
                self.known[word] = self.runs[parts[0]] if parts else 0

    def _make_room(self, rows: int) -> None:
        if self.used + rows > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), rows), self.table.shape[1]))])

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        sums = np.zeros((len(texts), len(self.languages) + 1))
        waiting: list[tuple[int, list[bytes]]] = []
        held = 0

        def flush() -> None:
            self.learn({w for _, part in waiting for w in part})
            for i, part in waiting:
                sums[i] += self.table[list(map(self.known.__getitem__, part))].sum(axis=0)

        # A long text is read in parts, so that there are never more new words than can be kept.
        for i, text in enumerate(texts):
            words = (text or b"").split()
            for start in range(0, len(words), AT_ONCE):
                part = words[start : start + AT_ONCE]
                if held + len(part) > AT_ONCE:
                    flush()
                    waiting, held = [], 0
                waiting.append((i, part))
                held += len(part)
        flush()
        return [self._judge(row) for row in sums]

    def _judge(self, sums: np.ndarray) -> tuple[str, float]:
        if not sums[-1]:
            return UNKNOWN, 0.0
        logs = sums[:-1] + self.priors
        best = int(np.argmax(logs))
        return self.languages[best], float(1.0 / np.exp(logs - logs[best]).sum())


_SCORES: list[WordScores] = []


def word_scores(model: LanguageModel) -> WordScores:
    """The scores of the model at hand, used again by later tasks of a Python worker."""
    if not _SCORES or _SCORES[0].name != model.name:
        _SCORES[:] = [WordScores(model)]
    return _SCORES[0]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = word_scores(shared.value)
        for batch in batches:
            found = scorer.predict(list(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD).alias("held_out"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInPandas(scan, "doc_id long, held_out boolean, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, least: float = ACCEPT) -> DataFrame:
    """Documents whose language is recognised with at least this certainty, all columns as they were.

    Rows are judged where they are; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = word_scores(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in scorer.predict(texts)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
