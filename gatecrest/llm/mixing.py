"""Mixing sources to time-varying target weights.

Over training time t in [0, 1] a source's weight goes in a straight line from one value to another, both normalised over
the sources. They are given for it, or else its share of the tokens to the powers ``start`` and ``end``. The integral of that line is the source's cumulative
demand; a document that follows c tokens of its source is due when the demand has reached c, which gives its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatecrest.llm.common import broadcast_if_small, cut

START, END, SEED = 0.7, 1.0, "mix"
#: Hex digits of the order hash that make the buckets of a source; a source's prefix sums are taken over buckets, then within.
DIGITS = 3


def tokens(text: Column | str) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("long")


def positions(docs: DataFrame, start: float = START, end: float = END, seed: str = SEED, schedules: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """docs with _tokens and _position, without the documents for which no demand is left.

    The order within a source is that of the md5 of the seed and doc_id, then of the number of tokens. The total demand
    is the number of tokens of the table. A source that has fewer tokens than its demand is used up, spread over the
    whole time; one that has more keeps the documents that begin before its demand is met. Nothing is repeated.

    schedules gives the first and last weight of sources by name, as multiples of one another and of the shares' powers
    that the other sources keep; none may be negative. A source of weight 0 throughout asks for nothing: of it only the
    first document is kept.

    A null source is a source of its own. Null ids share one place in the order. Null, empty and blank texts have no
    tokens and are kept, in their place; a source without tokens has position 0 throughout. Repeated rows follow each
    other. No rows give no rows.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.withColumn("_tokens", tokens("text")).withColumn("_tie", F.xxhash64("text")).withColumn("_source", F.concat(F.lit("s"), F.coalesce("source", F.lit("")), F.col("source").isNull().cast("string"))).withColumn("_order", key)
    rows = rows.withColumn("_bucket", F.substring("_order", 1, DIGITS))
    sums = rows.groupBy("_source", "_bucket").agg(F.sum("_tokens").alias("n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(sums.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    supply = sums.groupBy("_source").agg(F.sum("n").alias("_supply"))
    total = supply.agg(F.sum("_supply").alias("_total"))
    share = supply.join(F.broadcast(total), how="cross").withColumn("p", F.when(F.col("_total") > 0, F.col("_supply") / F.col("_total")).otherwise(0.0))
    powers = share.withColumn("a", F.when(F.col("p") > 0, F.pow("p", F.lit(start))).otherwise(0.0)).withColumn("b", F.when(F.col("p") > 0, F.pow("p", F.lit(end))).otherwise(0.0))
    if schedules:
        if any(w < 0 for pair in schedules.values() for w in pair):
            raise ValueError("weights must not be negative")
        given = F.create_map(*(x for name, (a, b) in sorted(schedules.items()) for x in (F.lit(f"s{name}false"), F.array(F.lit(float(a)), F.lit(float(b))))))
        powers = powers.withColumn("g", F.try_element_at(given, F.col("_source"))).withColumn("a", F.coalesce(F.col("g")[0], "a")).withColumn("b", F.coalesce(F.col("g")[1], "b")).drop("g")
    norm = powers.agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"))
    weights = powers.join(F.broadcast(norm), how="cross").select("_source", "_supply", "_total", F.coalesce(F.try_divide("a", "_na"), F.lit(0.0)).alias("_a"), F.coalesce(F.try_divide("b", "_nb"), F.lit(0.0)).alias("_b"))
    weights = weights.withColumn("_mean", (F.col("_a") + F.col("_b")) / 2).withColumn("_span", F.least(F.col("_total").cast("double"), F.try_divide("_supply", "_mean")))
    offsets = cut(sums.select("_source", "_bucket", "_before").join(weights.select("_source", "_a", "_b", "_mean", "_span"), "_source"))
    rows = rows.join(broadcast_if_small(offsets, offsets.count(), 120), ["_source", "_bucket"])
    within = Window.partitionBy("_source", "_bucket").orderBy("_order", "_tokens", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_c", F.col("_before") + F.coalesce(F.sum("_tokens").over(within), F.lit(0)))
    y = F.try_divide("_c", "_span")
    t = F.when(F.col("_c") == 0, 0.0).otherwise(F.try_divide(2 * y, F.col("_a") + F.sqrt(F.greatest(F.lit(0.0), F.col("_a") * F.col("_a") + 2 * (F.col("_b") - F.col("_a")) * y))))
    rows = rows.where((F.col("_c") == 0) | F.col("_span").isNull() | (F.col("_c") < F.col("_span") * F.col("_mean")) | ((F.col("_tokens") == 0) & (F.col("_c") <= F.col("_span") * F.col("_mean"))))
    return rows.withColumn("_position", F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0)))).drop("_source", "_order", "_tie", "_bucket", "_before", "_a", "_b", "_mean", "_span", "_c")


def schedule(docs: DataFrame, start: float = START, end: float = END, seed: str = SEED, schedules: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(doc_id, source, tokens, position), range-sorted by position; see positions()."""
    out = positions(docs.select("doc_id", "text", "source"), start, end, seed, schedules)
    out = cut(out.select("doc_id", "source", F.col("_tokens").alias("tokens"), F.round("_position", 6).alias("position")))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixed(docs: DataFrame, start: float = START, end: float = END, seed: str = SEED, schedules: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The rows of docs that positions() keeps, with all their columns, range-sorted by position."""
    names = docs.columns
    docs = docs.toDF(*(c if c in ("doc_id", "text", "source") else f"x{k}" for k, c in enumerate(names)))  # so that no name clashes
    out = positions(docs, start, end, seed, schedules).drop("_tokens")
    return out.repartitionByRange("_position", "doc_id").sortWithinPartitions("_position", "doc_id").drop("_position").select(docs.columns).toDF(*names)


def oracle(start: float = START, end: float = END, seed: str = SEED) -> str:
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+'))::BIGINT AS tokens, md5('{seed}:' || doc_id::VARCHAR) AS o FROM documents),
    c AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY o, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM d),
    s AS (SELECT source, sum(tokens)::DOUBLE AS supply FROM d GROUP BY 1),
    p AS (SELECT source, supply, sum(supply) OVER () AS total, power(supply / sum(supply) OVER (), {start}) AS a, power(supply / sum(supply) OVER (), {end}) AS b FROM s),
    w AS (SELECT source, supply, total, a / sum(a) OVER () AS a, b / sum(b) OVER () AS b FROM p),
    v AS (SELECT source, a, b, (a + b) / 2 AS mean, least(total, supply / ((a + b) / 2)) AS span FROM w)
    SELECT doc_id, source, tokens, round(CASE WHEN c = 0 THEN 0.0 ELSE least(1.0, 2 * (c / span) / (a + sqrt(greatest(0.0, a * a + 2 * (b - a) * (c / span))))) END, 6)::DOUBLE AS position
    FROM c JOIN v USING (source) WHERE c = 0 OR c < span * mean OR (tokens = 0 AND c <= span * mean)"""
