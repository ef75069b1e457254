"""Mixing sources to target weights by Poisson replication.

A source with share w of the wanted output and c of the input documents gets the
mean rate w * total / c. A document's uniform number comes from a hash of its id, its text's digest
and the seed, the Poisson distribution function is inverted at it, and the document is exploded by
that count. A second hash gives every copy its place in the global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table, written

#: Copies of one document beyond which the distribution function is cut, as a function of the mean.
TAIL = 12
#: Copies of one document that one task makes.
BLOCK = 4096
#: Shares of the sources in the output. Sources not named share DEFAULT_WEIGHT each.
WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.08, "src4": 0.08}
DEFAULT_WEIGHT = 0.03
SEED = 17


def uniform(*parts: Column | str) -> Column:
    """In [0, 1), from the first 52 bits of an md5 over the parts."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string"), F.lit("\x00")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def lowest(rate: Column) -> Column:
    """The least count that is drawn: below it lie exp(-72) of the distribution at most, 0 for rates to about 180."""
    return F.greatest(F.lit(0.0), F.floor(rate - F.lit(float(TAIL)) * F.sqrt(rate)) - TAIL).cast("long")


def highest(rate: Column) -> Column:
    """The greatest count that is drawn."""
    return (F.ceil(rate + F.lit(float(TAIL)) * F.sqrt(rate)) + TAIL).cast("long")


def walk(rate: Column, upto: Column) -> Column:
    """From the lowest count to the highest, the Poisson probabilities relative to the lowest's: their sum, and the first count at which it exceeds `upto`.

    One number each is carried along, so memory does not grow with the rate and time with its root only, which is less than the copies then take to write.
    `upto` is carried too, or the planner would find it anew at each step. Starting at the lowest count, nothing vanishes (exp(-rate) is 0 from 746) and nothing overflows.
    """

    def step(acc, k):
        total = acc["total"] + acc["p"]
        return F.struct((acc["p"] * rate / (k + 1)).alias("p"), total.alias("total"), (acc["times"] + (total <= acc["upto"]).cast("long")).alias("times"), acc["upto"].alias("upto"))

    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("total"), lowest(rate).alias("times"), upto.alias("upto"))
    return F.aggregate(F.sequence(lowest(rate), highest(rate)), start, step)


def mass(rate: Column) -> Column:
    """The sum of the relative probabilities."""
    return walk(rate, F.lit(0.0))["total"]


def times_at(u: Column, rate: Column, whole: Column) -> Column:
    """The count at which the distribution function of mean `rate` and mass `whole` passes `u`, in [0, 1)."""
    return walk(rate, u * whole)["times"]


def rates(docs: DataFrame, weights: dict[str, float] = WEIGHTS, default: float = DEFAULT_WEIGHT, total: int | None = None) -> DataFrame:
    """One row per source: source, rate, mass. `total` documents are wanted on average, by default as many as there are.

    Weights are divided by their sum over the sources that occur; a null source is a source like others.
    """
    weight = F.lit(float(default))
    for name, w in weights.items():
        weight = F.when(F.col("source") == F.lit(name), F.lit(float(w))).otherwise(weight)
    n = written(docs.groupBy("source").agg(F.count("*").alias("n")).withColumn("weight", weight))
    docs_in, weights_in = n.agg(F.sum("n"), F.sum("weight")).first()
    wanted = F.lit(float(total if total is not None else docs_in or 0))
    rate = F.col("weight") / F.lit(weights_in) * wanted / F.col("n") if weights_in else F.lit(0.0)
    return n.withColumn("rate", rate).select("source", "rate", mass(F.col("rate")).alias("mass"))


def replicate(docs: DataFrame, weights: dict[str, float] = WEIGHTS, default: float = DEFAULT_WEIGHT, total: int | None = None, seed: int = SEED, salts: int = 16) -> DataFrame:
    """`docs` with each row as many times as its Poisson number says, shuffled, and the columns copy (from 1) and place, named by `fresh`.

    Rows with null id, source or text are drawn like others; equal rows draw the same number.
    Copies are dealt to partitions by a hash of their place and sorted by it inside each: rows of one source or text land apart, and the order
    by place, which no run of the job changes, can be had by a sort of the output where one file after another is read.
    The rates are written first, so the planner knows their size: few sources are broadcast and no text moves before the shuffle of
    the copies; many are joined on (source, salt), so that a source with a third of the rows is spread.
    A document of more than BLOCK copies is dealt to tasks by blocks of so many, so that the only row of a source is not one task's work. More than 2^31 copies are an error.
    """
    given = docs.columns
    copy, place, u, at, times, block = (fresh(given, x) for x in ("copy", "place", "mix_u", "mix_at", "mix_times", "mix_block"))
    source, rate, whole, own_salt = (fresh(given, x) for x in ("mix_source", "mix_rate", "mix_mass", "mix_salt"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    per_source = written(rates(docs, weights, default, total)).select(F.col("source").alias(source), F.col("rate").alias(rate), F.col("mass").alias(whole)).withColumn(own_salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    drawn = docs.withColumns({u: uniform("doc_id", F.md5(F.coalesce("text", F.lit(""))), F.lit(seed)), at: salt})
    own = [F.col(f"`{c}`") for c in given]

    def counted(of: DataFrame) -> DataFrame:
        joined = drawn.join(of, F.col("source").eqNullSafe(F.col(source)) & (F.col(at) == F.col(own_salt)))
        return joined.select(*own, times_at(F.col(u), F.col(rate), F.col(whole)).cast("int").alias(times))

    few = counted(per_source).where(F.col(times).between(1, BLOCK)).select(*own, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy))
    # only sources whose highest count passes a block are read here: none in most corpora
    many = counted(per_source.where(highest(F.col(rate)) > BLOCK)).where(F.col(times) > BLOCK)
    blocks = many.select(*own, times, F.explode(F.sequence(F.lit(0), ((F.col(times) - 1) / BLOCK).cast("int"))).alias(block)).repartition(F.xxhash64("doc_id", block))
    last = F.least(F.col(times), (F.col(block) + 1) * BLOCK)
    copies = few.unionByName(blocks.select(*own, F.explode(F.sequence(F.col(block) * BLOCK + 1, last)).alias(copy)))
    placed = copies.withColumn(place, uniform("doc_id", copy, F.lit(seed), F.lit("place")))
    return placed.repartition(F.col(place)).sortWithinPartitions(place, "doc_id", copy)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents"))


_WEIGHT = "case source " + " ".join(f"when '{s}' then {w}::double" for s, w in WEIGHTS.items()) + f" else {DEFAULT_WEIGHT}::double end"
_HIGHEST = f"ceil(rate + {TAIL}.0 * sqrt(rate)) + {TAIL}"
_LOWEST = f"greatest(0, floor(rate - {TAIL}.0 * sqrt(rate)) - {TAIL})"
# probabilities relative to the one at the mode, up and down from it
SQL = f"""
with recursive sources as (select source, count(*)::double as n, {_WEIGHT} as weight from documents group by source),
rates as (select source, weight / sum(weight) over () * sum(n) over () / n as rate from sources),
up as (
  select source, rate, floor(rate)::bigint as k, 1.0::double as p from rates
  union all
  select source, rate, k + 1, p * rate / (k + 1) from up where k < {_HIGHEST}),
down as (
  select source, rate, floor(rate)::bigint as k, 1.0::double as p from rates
  union all
  select source, rate, k - 1, p * k / rate from down where k > {_LOWEST}),
steps as (
  select source, k, sum(p) over (partition by source order by k) / sum(p) over (partition by source) as total
  from (select source, k, p from up union select source, k, p from down)),
least_times as (select source, min(k) as low from steps group by source),
drawn as (
  select *, ('0x' || md5(doc_id::varchar || chr(31) || md5(coalesce(text, '')) || chr(31) || '{SEED}')[1:13])::bigint::double / 4503599627370496.0 as u from documents),
times as (
  select d.doc_id, d.u, any_value(l.low) + count(s.k) as n
  from drawn d join least_times l on l.source is not distinct from d.source
  left join steps s on s.source is not distinct from d.source and s.total <= d.u group by d.doc_id, d.u)
select d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::int as copy,
  ('0x' || md5(d.doc_id::varchar || chr(31) || c.copy::varchar || chr(31) || '{SEED}' || chr(31) || 'place')[1:13])::bigint::double / 4503599627370496.0 as place
from documents d join times t using (doc_id), lateral (select unnest(range(1, t.n + 1)) as copy) c
"""
