"""Mixing of sources to target weights by iterative proportional fitting, with built-in column functions only.

Documents fall into cells by source, language and topic. The tokens of the cells are raked: each margin in turn is scaled to its
target shares, until all three hold. A document is then drawn with the probability of its cell, the fitted tokens
over those there are. The whole is scaled so that the highest probability is one: no document is
repeated, and the margins of the sample meet their targets in expectation. Draws are hashes of the id, so
a sample is the same on every run.

The default targets temper the shares found, which lifts rare sources, languages and topics. Everything after the first count works on
cells, whose number is that of sources times languages times topics met; the sweeps write their state out. They end when every margin is within
``TOLERANCE`` of its target. Cells that are missing can make targets impossible to meet together; the sweeps then end when they bring nothing more, and
``off``, the largest difference left between a margin's share and its target, says how far they got.

Defined cases: nulls are a class of their own in each margin; documents without tokens have weight zero and aren't drawn; target classes
that don't occur are left out and the rest scaled up; a class without a target isn't drawn; rows that share an id are drawn together; equal rows give equal
rows; no documents, no rows; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewake.llm.common import table
from tradewake.session import cut_lineage

MARGINS = ("source", "lang", "topic")
# Exponent on the shares found; one keeps the mix, zero makes all classes of a margin equal.
TEMPER = 0.95
TOLERANCE = 1e-9
# Sweeps between two looks at the margins.
SWEEPS = 8
NONE = "-"


def topic_of(text: Column) -> Column:
    """A coarse topic by the kind of text: table, listing, marked-up or code-like text, figures, short notes, prose."""
    n = F.greatest(F.length(text), F.lit(1))

    def share(characters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, characters, ""))) / n

    return (
        F.when(share("|\t") > 0.03, "table")
        .when(share("{}[]<>=;#$%&*_\\/") > 0.06, "markup")
        .when(share("0123456789") > 0.1, "figures")
        .when(share("\n") > 0.03, "listing")
        .when(F.length(text) < 400, "note")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def classed(docs: DataFrame, keep: Sequence[str] = ("*",)) -> DataFrame:
    """The rows, or the columns of them to keep, as one column, beside their id, classes and tokens, so that no other column's name can clash.

    Written out: the texts are classed once, and later steps read the columns they need.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return cut_lineage(docs.select(
        F.struct(*keep).alias("_row"), F.col("doc_id").cast("string").alias("_id"), tokens_of(text).alias("tokens"),
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"), topic_of(text).alias("topic"),
    ))


def tempered(cells: DataFrame, margin: str, exponent: float = TEMPER) -> DataFrame:
    """(class, share): shares of a margin raised to the exponent."""
    return cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), exponent).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with fitted weights, and the largest error left: column ``fitted`` sums to the target shares in every margin up to ``off``.

    cells: one row per cell with tokens; targets: per margin (class, share).
    """
    state = cells.withColumn("fitted", F.col("tokens").cast("double"))
    aims = {}
    for margin, shares in targets.items():
        met = shares.join(cells.select(margin).distinct(), margin, "left_semi")
        total = met.agg(F.sum("share")).first()[0]
        aims[margin] = cut_lineage(met.select(margin, (F.col("share") / F.lit(float(total or 1.0))).alias("aim")))
    for margin, aim in aims.items():
        state = state.join(aim.withColumnRenamed("aim", f"aim_{margin}"), margin)
    state = cut_lineage(state)
    off = None
    while True:
        for _ in range(SWEEPS):
            for margin in aims:
                # Over cells, not documents: a class has at most as many rows as the other margins have class pairs.
                total = F.sum("fitted").over(Window.partitionBy(margin))
                state = state.withColumn("fitted", F.when(total > 0, F.col("fitted") / total * F.col(f"aim_{margin}")).otherwise(0.0))
        state = cut_lineage(state)
        errors = [state.groupBy(m).agg(F.abs(F.sum("fitted") - F.first(f"aim_{m}")).alias("e")).agg(F.max("e")).first()[0] or 0.0 for m in aims]
        before, off = off, max(errors, default=0.0)
        if off <= tolerance or (before is not None and off > 0.9 * before):
            return state.select(*MARGINS, "tokens", "fitted", F.lit(float(off)).alias("off"))


def probabilities(docs: DataFrame, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE, keep: Sequence[str] = ("*",)) -> tuple[DataFrame, DataFrame]:
    """The classed rows, and (source, lang, topic, tokens, fitted, off, chance) per cell."""
    rows = classed(docs, keep)
    cells = cut_lineage(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"))
    fitted = rake(cells, targets or {m: tempered(cells, m) for m in MARGINS}, tolerance)
    most = fitted.agg(F.max(F.col("fitted") / F.col("tokens")).alias("most")).first()["most"]
    return rows, cut_lineage(fitted.withColumn("chance", F.col("fitted") / F.col("tokens") / F.lit(float(most or 1.0))))


def draw(identity: Column) -> Column:
    """A number from 0 to 1 that depends on the id only."""
    return F.conv(F.substring(F.md5(F.coalesce(identity, F.lit(NONE))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def chosen(docs: DataFrame, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE, keep: Sequence[str] = ("*",)) -> DataFrame:
    """Classed rows that are drawn, with the chance they had."""
    rows, cells = probabilities(docs, targets, tolerance, keep)
    return rows.join(cells.select(*MARGINS, "chance"), list(MARGINS)).filter(draw(F.col("_id")) < F.col("chance"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents drawn, with all their columns."""
    return chosen(docs, targets, tolerance).select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No text is needed once it is classed.
    drawn = chosen(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return drawn.select(F.col("_row.doc_id").cast("long").alias("doc_id"), "source", "lang", "topic", "tokens", F.round("chance", 6).alias("chance"))
