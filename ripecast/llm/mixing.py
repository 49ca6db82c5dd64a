"""Sources mixed to target weights by Poisson replication.

Every source gets a mean repetition rate: its target share of the bytes over its actual bytes. A
document's number of copies is the inverse of the Poisson distribution function with that mean at a
uniform number hashed from seed and id, so it depends on nothing but id, seed and rate, and no
state is shared between tasks. Copies are then dealt over all partitions by a hashed key.

Defined results: a null source counts as the source named by the empty text; a null text has no
bytes; rows that share an id get the same number of copies; a source without bytes, or with weight 0 or
without weight, has rate 0 and gives no rows; an empty table gives none. Other columns are kept; an input column named
repeats, replica, rate or shuffle_key is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripecast.llm import text

SEED = 17
SALTS = 64
TEMPER = 0.5  # without explicit weights: weight of a source = its bytes to this power


def uniform(*parts):
    """A number in [0, 1) from the md5 of the parts: 52 bits, the same in every SQL engine."""
    joined = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = TEMPER) -> DataFrame:
    """(source_key, bytes, rate), a row per source. The output has as many bytes as the input, on average."""
    text.require(docs, "text", "source")
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key")).agg(
        F.sum(text.utf8_bytes(F.col("text"))).alias("bytes"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(float(temper))))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        given = docs.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], "source_key string, weight double")
        weighted = sizes.join(given, "source_key", "left").fillna(0.0, ["weight"])
    # One row: the totals over all sources that can be repeated at all.
    totals = weighted.filter("bytes > 0").agg(
        F.sum("bytes").alias("all_bytes"), F.sum(F.col("weight").cast("decimal(28,6)")).cast("double").alias("all_weight"))
    rate = F.col("weight") / F.col("all_weight") * F.col("all_bytes") / F.col("bytes")
    return weighted.join(F.broadcast(totals)).select(
        "source_key", "bytes",
        F.when((F.col("bytes") > 0) & (F.col("all_weight") > 0), rate).otherwise(0.0).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """Adds `steps`, the distribution function at 0, 1, 2, ... up to where a double has no room above it.

    Its length grows with the rate alone. Terms are computed as logarithms, so that a large rate
    does not underflow.
    """
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    terms = rates.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    upto = W.partitionBy("source_key").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    log_factorial = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(0.0)).over(upto)
    power = F.when(F.col("rate") > 0, F.col("k") * F.log("rate")).otherwise(
        F.when(F.col("k") == 0, 0.0).otherwise(float("-inf")))
    at = terms.withColumn("p", F.exp(power - F.col("rate") - log_factorial))
    cum = at.withColumn("c", F.sum("p").over(upto))
    return cum.groupBy("source_key", "rate").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda s: s["c"]).alias("steps"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = SEED, temper: float = TEMPER) -> DataFrame:
    """Every document `repeats` times, with replica 1 to repeats, rate and shuffle_key, in global random order."""
    text.require(docs, "doc_id", "text", "source")
    rates = poisson_steps(source_rates(docs, weights, temper))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    own = ("repeats", "replica", "rate", "shuffle_key", "source_key", "steps", "salt")
    # Should the rates be too many to broadcast, a hot source still spreads over SALTS tasks.
    keyed = docs.drop(*own).withColumns({
        "source_key": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = keyed.join(salted, ["source_key", "salt"]).drop("salt").withColumn("u", uniform(F.lit(str(seed)), ident))
    counted = joined.withColumn("repeats", F.size(F.filter("steps", lambda c: c <= F.col("u")))).drop("steps", "source_key", "u")
    copies = counted.filter("repeats > 0").withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    keyed = copies.withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.col("replica").cast("string"), ident)), 1, 15), 16, 10).cast("bigint"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "replica")
