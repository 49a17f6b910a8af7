"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: the share of the mix it should get
over the share it has. A document's number of copies is a Poisson variable of
that mean, found by inverting the distribution at a number in [0, 1) that a
seeded hash of the document's id gives. So the mix is the same whatever the
partitioning, a lost task gives the same copies again, and no source is ever
gathered: the rates come from one aggregate with map-side sums, and copies are
made where the document is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkvox.llm.common import filled, unused, written

#: Hex digits of the hash that make the uniform number: 52 bits, exact in a double.
HASH_DIGITS = 13


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the seeded md5 of a key; the same in any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double") / F.lit(float(16**HASH_DIGITS))


def source_rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    source_col: str = "source",
    text_col: str = "text",
    temperature: float = 0.5,
    total: float | None = None,
) -> DataFrame:
    """``(source, mass, rate)`` per source.

    mass: code points of the source's texts. Target shares: ``weights``
    (a source that it lacks gets none), else mass to the power
    ``temperature``. ``total``: the mix's mean mass, by default the input's.
    A source without mass has nothing to scale and keeps rate 1, or 0 if
    ``weights`` leaves it out. Null is a source like any other."""
    sizes = written(
        docs.groupBy(F.col(source_col).alias("source"))
        .agg(F.sum(F.length(filled(F.col(text_col))).cast("long")).alias("mass")),
        "mix_sizes",
    )
    if weights is None:
        weight = F.pow(F.col("mass").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    weighed = sizes.withColumn("weight", weight)
    sums = weighed.agg(F.sum("mass").alias("mass"),
                       F.sum(F.when(F.col("mass") > 0, F.col("weight"))).alias("weight")).first()
    mass = float(total if total is not None else sums["mass"] or 0)
    scale = mass / sums["weight"] if sums["weight"] else 0.0
    return weighed.select(
        "source", "mass",
        F.when(F.col("mass") > 0, F.col("weight") * F.lit(scale) / F.col("mass"))
        .when(F.col("weight") > 0, 1.0).otherwise(0.0 if weights is not None else 1.0).alias("rate"),
    )


def poisson_steps(rates: DataFrame) -> DataFrame:
    """``(source, rate, steps)``: the cumulative Poisson probabilities of 0, 1,
    2, ... copies, far enough that what lies beyond is below 1e-16. The array
    is as long as the rate needs, about rate + 12 sqrt(rate) + 30."""
    ks = rates.withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    log_factorial = F.sum(F.when(F.col("k") > 0, F.ln("k")).otherwise(0.0)).over(upto)
    ks = ks.withColumn(
        "p",
        F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate") - log_factorial))
        .when(F.col("k") == 0, 1.0).otherwise(0.0))
    ks = ks.withColumn("cdf", F.sum("p").over(upto))
    return (ks.groupBy("source", "rate").agg(F.sort_array(F.collect_list("cdf")).alias("steps")))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    temperature: float = 0.5,
    total: float | None = None,
    seed: int = 17,
) -> DataFrame:
    """The mix: every column of ``docs``, plus ``copy`` (from 1) and
    ``mix_key`` (the row's place in the global shuffle), in shuffled order.

    Rows with the same id get the same number of copies; null ids count as
    one id; null and empty texts have no mass and are mixed like the rest; an
    empty table gives an empty mix. If the input has a column ``copy`` or
    ``mix_key``, the added one gets underscores."""
    copy, key, src, rate, steps, u = unused(docs, "copy", "mix_key", "_source", "_rate", "_steps", "_u")
    plan = written(
        poisson_steps(source_rates(docs, weights, source_col=source_col, text_col=text_col,
                                   temperature=temperature, total=total)), "mix_plan"
    ).toDF(src, rate, steps)
    # One row a source, read from a written table: broadcast if its files are
    # small, else a shuffled join whose hot sources AQE splits.
    joined = docs.join(plan, docs[source_col].eqNullSafe(plan[src]), "inner")
    counted = joined.withColumn(u, uniform(F.col(id_col), seed))
    n = F.size(F.filter(F.col(steps), lambda c: c <= F.col(u)))
    copies = counted.withColumn(copy, F.explode(F.when(n > 0, F.sequence(F.lit(1), n))))
    shuffled = copies.withColumn(
        key, F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.col(id_col).cast("string"),
                               F.col(copy).cast("string")).cast("binary")))
    # A random key deals the copies out evenly; sorting by it inside the
    # partitions makes the order random over the whole mix without sampling.
    return shuffled.repartition(key).sortWithinPartitions(key).select(*docs.columns, copy, key)


def oracle_sql(temperature: float = 0.5, seed: int = 17) -> str:
    """The same mix in DuckDB over ``documents``."""
    return f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS mass FROM documents GROUP BY source),
sums AS (SELECT sum(mass)::DOUBLE AS mass, sum(pow(mass::DOUBLE, {temperature})) AS weight FROM sizes WHERE mass > 0),
rates AS (SELECT source, CASE WHEN s.mass > 0 THEN pow(s.mass::DOUBLE, {temperature}) * (t.mass / t.weight) / s.mass ELSE 1 END AS rate FROM sizes s, sums t),
ks AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rates),
ps AS (SELECT source, rate, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING)) WHEN k = 0 THEN 1 ELSE 0 END AS p FROM ks),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM ps),
steps AS (SELECT source, list(c ORDER BY k) AS steps FROM cdf GROUP BY source),
us AS (SELECT d.*, ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '')), 1, {HASH_DIGITS}))::BIGINT::DOUBLE / {float(16**HASH_DIGITS)!r} AS u FROM documents d),
ns AS (SELECT us.*, len(list_filter(steps, lambda c: c <= u)) AS n FROM us JOIN steps ON us.source IS NOT DISTINCT FROM steps.source)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
  md5(concat_ws('|', '{seed}', 'order', doc_id::VARCHAR, copy::VARCHAR)) AS mix_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM ns WHERE n > 0)
"""
