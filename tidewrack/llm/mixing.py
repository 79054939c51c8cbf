"""Mixing sources to target weights by iterative proportional fitting (raking)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.common import broadcast_if_small, settled

MARGINS = ("source", "lang", "topic")


def word_count(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    return F.coalesce(F.size(words), F.lit(0)).cast("long")


def shape_topic(text: Column) -> Column:
    """A coarse topic told from the form of a text: table, listing, note or prose."""
    t = F.coalesce(text, F.lit(""))
    bars = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return (
        F.when(bars * 20 > F.length(t), "table")
        .when(breaks >= 24, "listing")
        .when(F.length(t) < 600, "note")
        .otherwise("prose")
    )


def tempered_shares(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, share): present shares of tokens raised to `power` and made to sum to one."""
    sums = cells.groupBy(margin).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("t"))
    everything = sums.agg(F.sum("t").alias("all")).scalar()
    return sums.withColumn("all", everything).select(margin, (F.col("t") / F.col("all")).alias("share"))


def _joined(cells: DataFrame, other: DataFrame, on: tuple[str, ...], how: str = "inner") -> DataFrame:
    """An equi-join in which null equals null; the other side's keys are dropped."""
    named = other.select(*(F.col(c).alias(f"__{c}") for c in on), *(c for c in other.columns if c not in on))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    return cells.join(named, same, how).drop(*(f"__{c}" for c in on))


def raked(
    cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-6, most_rounds: int = 40, per_write: int = 4
) -> DataFrame:
    """`cells` with a `weight` whose sums over each margin have the target shares.

    cells: the margin columns and `tokens` > 0. targets: for each margin (value, share); shares of
    values without tokens are left out and the others scaled up, values without a target get none.
    Each round scales the weights to one margin after the other. Rounds end when no margin is off by
    over `tolerance` of all weight, or after `most_rounds` (targets may contradict empty cells).
    The sums of a round are windows over the cells, and only the largest gap comes to the driver.
    """
    for margin, shares in targets.items():
        cells = _joined(cells, shares.select(margin, F.col("share").alias(f"want_{margin}")), (margin,), "left")
        cells = cells.withColumn(f"want_{margin}", F.coalesce(f"want_{margin}", F.lit(0.0)))
        first = F.row_number().over(Window.partitionBy(margin).orderBy(*targets)) == 1
        cells = cells.withColumn(f"once_{margin}", F.when(first, F.col(f"want_{margin}")).otherwise(0.0))
    cells = settled(cells)
    present = cells.agg(*(F.sum(f"once_{m}").alias(m) for m in targets)).first().asDict()
    start = F.col("tokens").cast("double")
    for margin in targets:
        cells = cells.withColumn(f"want_{margin}", F.col(f"want_{margin}") / F.lit(present[margin] or 1.0))
        start = F.when(F.col(f"want_{margin}") > 0, start).otherwise(0.0)
    cells = cells.drop(*(f"once_{m}" for m in targets)).withColumn("weight", start)
    total = cells.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    if not total:
        return cells.drop(*(f"want_{m}" for m in targets))
    cells = cells.withColumn("weight", F.col("weight") / F.lit(total))
    for _ in range(0, most_rounds, per_write):
        for _ in range(per_write):
            for margin in targets:
                held = F.sum("weight").over(Window.partitionBy(margin))
                cells = cells.withColumn("held", held).withColumn(
                    "weight", F.when(F.col("held") > 0, F.col("weight") * F.col(f"want_{margin}") / F.col("held")).otherwise(0.0)
                )
        cells = settled(cells.drop("held"))
        gap = 0.0
        for margin in targets:
            off = cells.groupBy(margin).agg(F.abs(F.sum("weight") - F.first(f"want_{margin}")).alias("off"))
            gap = max(gap, off.agg(F.max("off")).first()[0] or 0.0)
        if gap <= tolerance:
            break
    return cells.drop(*(f"want_{m}" for m in targets))


def scale_for(cells: DataFrame, keep: float | None) -> float:
    """The factor c at which min(1, c * ratio) keeps the share `keep` of the tokens in expectation.

    It is at least the one that brings the largest ratio to one, which clips no cell; without a
    `keep` it is that one. What clipped cells cannot give goes to the others in proportion. Each
    round clips more cells, until a round clips no further one; only sums come to the driver.
    """
    most, tokens = cells.agg(F.max("ratio"), F.sum("tokens")).first()
    if not most:
        return 1.0
    exact = scale = 1.0 / most
    while keep is not None:
        full = F.col("ratio") * F.lit(scale) >= 1
        held, open_weight = cells.agg(
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        wider = (keep * tokens - held) / open_weight if open_weight > 0 else 0.0
        if wider <= scale * (1 + 1e-9):
            break
        scale = wider
    return max(exact, scale)


def calibrated(
    docs: DataFrame, powers: dict[str, float], topic: Column | None = None,
    targets: dict[str, DataFrame] | None = None, keep: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` with their margins and tokens, and (margins, probability) of each cell.

    A cell's probability is its raked weight per token, times one factor and at most one. Without
    `keep` the factor makes the largest probability one: the expected tokens kept have the target
    shares exactly, but the rarest cell sets how much is kept. With `keep` it is raised until that
    share of the tokens is kept; cells that are whole before that stay below their target.
    """
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        "source", "lang", (shape_topic(text) if topic is None else topic).alias("topic"),
        word_count(text).alias("tokens"),
    )
    rows = settled(rows)
    cells = settled(rows.where("tokens > 0").groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    wanted = targets or {m: settled(tempered_shares(cells, m, powers[m])) for m in MARGINS}
    done = raked(cells, wanted).withColumn("ratio", F.col("weight") / F.col("tokens"))
    done = settled(done)
    probability = F.least(F.lit(1.0), F.col("ratio") * F.lit(scale_for(done, keep)))
    return rows, settled(done.select(*MARGINS, probability.alias("probability")))


#: Present shares to the power of these make the targets: a dominant source is cut down most.
POWERS = {"source": 0.5, "lang": 0.8, "topic": 0.8}
#: At least this share of the tokens is kept by the query and the pipeline.
KEEP = 0.5


def mixed(
    docs: DataFrame, powers: dict[str, float] = POWERS, seed: int = 7, topic: Column | None = None,
    targets: dict[str, DataFrame] | None = None, keep: float | None = None,
) -> DataFrame:
    """(doc_id, text_hash, source, lang, topic, tokens, probability, kept) per row of `docs`.

    A row is kept if a hash of its id and text, as a number from 0 to 1, is below its cell's
    probability; so the choice is the same at every run and for repeated rows. Null sources and
    languages are values of their own. Texts without words weigh nothing and are kept by the largest
    probability, one. An empty table gives no rows. Other columns are not used.
    """
    rows, cells = calibrated(docs, powers, topic, targets, keep)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 11) / F.lit(float(1 << 53))
    return (
        _joined(rows, broadcast_if_small(cells, 100), MARGINS, "left")
        .withColumn("probability", F.when(F.col("tokens") > 0, F.col("probability")).otherwise(1.0))
        .withColumn("kept", draw < F.col("probability"))
    )


def keep_mixed(
    docs: DataFrame, powers: dict[str, float] = POWERS, seed: int = 7, keep: float | None = None
) -> DataFrame:
    """The rows of `docs` that `mixed` keeps, with their columns."""
    own = [f"__{c}" for c in MARGINS]
    _, cells = calibrated(docs, powers, keep=keep)
    named = cells.select(*(F.col(c).alias(o) for c, o in zip(MARGINS, own, strict=True)), F.col("probability").alias("__p"))
    here = docs.withColumn("__t", shape_topic(F.col("text"))).withColumn("__n", word_count(F.col("text")))
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in zip(("source", "lang", "__t"), own, strict=True)]
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.xxhash64("text")), 11) / F.lit(float(1 << 53))
    sure = F.when(F.col("__n") > 0, F.col("__p")).otherwise(1.0)
    return here.join(broadcast_if_small(named, 100), same, "left").where(draw < sure).select(*docs.columns)
