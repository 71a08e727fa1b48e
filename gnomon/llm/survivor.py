"""Best representative of each duplicate group, by a latent two-sided quality model.

Each source of a group asserts some values of a field and, by covering the group
without asserting them, denies the others. Expectation-maximisation infers how often
each source asserts what is true (sensitivity) and denies what is false (specificity),
and with them which values of each field are true; a field may keep several. How far a
field's claims can be trusted is the weight of that field, and the row of the greatest
weighted worth survives, the better source first where rows tie. Weights are positive,
so a row that is no worse anywhere and better than each other somewhere always survives.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gnomon.llm.formatting import collapse
from gnomon.session import materialize

# The statuses, best first.
STATUSES = ("VERIFIED_EXACT", "VERIFIED_NORMALIZED", "AMBIGUOUS", "TIME_TEXT_NOT_FOUND")
# Fixed values end.
FIELDS = ("source_name", "quality_status", "highlight_start")
MOST_SOURCES = 10_000  #: the sources table may hold no more; all unlisted names are one source
ROUNDS, SETTLED = 25, 0.02  #: at most so many rounds, till no estimate moves by more
LEAST_WEIGHT = 0.01  #: of a field whose claims tell nothing
PRIOR_TRUE = 0.5
#: Pseudo-counts: a source is taken to assert most true values and deny nearly all false ones.
SENSITIVE, SPECIFIC = (4.0, 2.0), (9.0, 1.0)


@dataclass
class Quality:
    """Sensitivity and specificity of each source (its place in ``names``; 0 is every unlisted one) for each field."""

    names: list[str]
    sensitivity: list[list[float]]
    specificity: list[list[float]]

    def _at(self, table: list[list[float]], field: Column) -> Column:
        # one literal for each field, which the optimizer folds into an array
        return F.element_at(F.array(*map(numbers, table)), field + 1)

    def posterior(self, field: Column, covering: Column, asserting: Column) -> Column:
        """Probability that a value is true, given the sources of its group and those that assert it."""
        deny = [[math.log((1 - a) / b) for a, b in zip(*x)] for x in zip(self.sensitivity, self.specificity)]
        more = [[math.log(a / (1 - b)) - math.log((1 - a) / b) for a, b in zip(*x)] for x in zip(self.sensitivity, self.specificity)]
        odds = F.lit(math.log(PRIOR_TRUE / (1 - PRIOR_TRUE)))

        def summed(sources: Column, weights: Column) -> Column:
            return F.aggregate(sources, F.lit(0.0), lambda total, s: total + F.element_at(weights, s + 1))

        odds = odds + summed(covering, self._at(deny, field)) + summed(asserting, self._at(more, field))
        return 1 / (1 + F.exp(-odds))

    def trust(self, source: Column) -> Column:
        """How much better than chance a source is, over all fields: the mean of sensitivity + specificity - 1."""
        means = [sum(a + b - 1 for a, b in zip(x, y)) / len(FIELDS) for x, y in zip(zip(*self.sensitivity), zip(*self.specificity))]
        return F.element_at(numbers(means), source + 1)

    def weights(self) -> list[float]:
        """How much each field's claims tell, over all sources: positive."""
        means = [sum(a + b - 1 for a, b in zip(x, y)) / len(x) for x, y in zip(self.sensitivity, self.specificity)]
        return [max(LEAST_WEIGHT, m) for m in means]


def numbers(values: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def source_names(sources: DataFrame) -> list[str]:
    """The names in ``sources``, of which there are at most ``MOST_SOURCES``."""
    names = sorted(r[0] for r in sources.select("source_name").filter("source_name is not null").distinct().limit(MOST_SOURCES + 1).collect())
    if len(names) > MOST_SOURCES:
        raise ValueError("too many sources to hold their quality on the driver")
    return names


def members(quotes: DataFrame, sources: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows that have copies, with ``source`` (a number, 0 if unlisted) and their ranks in each field; and the sources' names."""
    names = source_names(sources)
    rows = collapse(quotes, "quote_id", "quote", keep=(*FIELDS, "created_at"))
    listed = quotes.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names, 1)], "source_name string, number int")
    rows = rows.join(F.broadcast(listed), "source_name", "left")  # no more than MOST_SOURCES rows
    status = F.lit(0)
    for rank, name in enumerate(reversed(STATUSES), 1):
        status = F.when(F.col("quality_status") == name, rank).otherwise(status)
    rows = rows.select("first_id", "copies", "quote_id", *FIELDS, "created_at", F.coalesce("number", F.lit(0)).alias("source"), status.alias("status_rank"))
    return materialize(rows), names


def claims(rows: DataFrame) -> DataFrame:
    """One row for each value of a field in a group: the sources that cover the group and those that assert the value. Both lists hold a source once, so they are no longer than the sources table."""
    sources_of = F.array_sort(F.collect_set("source"))
    covering = rows.groupBy("first_id").agg(sources_of.alias("covering"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.col(c).cast("string").alias("value")) for i, c in enumerate(FIELDS))))
    asserted = rows.select("first_id", "source", each.alias("x")).filter("x.value is not null").groupBy("first_id", "x.field", "x.value").agg(sources_of.alias("asserting"))
    return asserted.join(covering, "first_id")


def infer(facts: DataFrame, names: list[str], rounds: int = ROUNDS) -> Quality:
    """Expectation-maximisation over all facts, until it settles. Facts with the same sources are one pattern with a count, so a round reads patterns only."""
    size = len(names) + 1
    quality = Quality(names, [[0.8] * size for _ in FIELDS], [[0.9] * size for _ in FIELDS])
    patterns = materialize(facts.groupBy("field", "covering", "asserting").agg(F.count("*").alias("n")))
    for _ in range(rounds):
        p = quality.posterior(F.col("field"), F.col("covering"), F.col("asserting"))
        seen = patterns.withColumn("p", p).select("field", "n", "p", "asserting", F.explode("covering").alias("source"))
        said = F.array_contains("asserting", F.col("source"))
        true, false = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = seen.groupBy("field", "source").agg(F.sum(F.when(said, true).otherwise(0.0)).alias("hit"), F.sum(true).alias("true"), F.sum(F.when(said, 0.0).otherwise(false)).alias("denied"), F.sum(false).alias("false"))
        moved = 0.0
        for r in sums.collect():  # a row for each field and source
            for held, value in ((quality.sensitivity[r.field], (r.hit + SENSITIVE[0]) / (r.true + sum(SENSITIVE))), (quality.specificity[r.field], (r.denied + SPECIFIC[0]) / (r.false + sum(SPECIFIC)))):
                moved = max(moved, abs(held[r.source] - value))
                held[r.source] = value
        if moved <= SETTLED:
            break
    return quality


def survivors(rows: DataFrame, quality: Quality) -> DataFrame:
    """One row for each group: the survivor, and whether it is no worse than every other row in each field and better than each in one (``dominant``).

    The model names the survivor: the greatest sum of the fields' ranks by their weights, then the latest, then the best source. The check of dominance follows, on that row.
    """
    ranks = {"status": F.col("status_rank"), "marked": F.col("highlight_start").isNotNull().cast("int"), "listed": (F.col("source") > 0).cast("int"), "at": F.coalesce(F.unix_micros("created_at"), F.lit(-(2**62)))}
    listed, status, marked = quality.weights()
    worth = listed * ranks["listed"] + status * ranks["status"] / len(STATUSES) + marked * ranks["marked"]
    best = F.struct(worth.alias("worth"), ranks["at"].alias("at"), *(ranks[k].alias(k) for k in ("status", "marked", "listed")))
    trust = quality.trust(F.col("source"))
    found = rows.groupBy("first_id").agg(
        F.max(F.struct(best.alias("best"), trust.alias("trust"), (-F.col("quote_id")).alias("id"))).alias("top"),
        F.max(F.struct(best.alias("best"), F.col("quote_id").alias("id")))["id"].alias("last_id"),
        (-F.max(F.struct(best.alias("best"), (-F.col("quote_id")).alias("id")))["id"]).alias("lowest_id"),
        F.max("copies").alias("copies"),
        (F.min("quote_id") < F.max("quote_id")).alias("several"),
        *(F.max(v).alias(f"most_{k}") for k, v in ranks.items()),
    )
    whole = reduce(Column.__and__, (F.col(f"top.best.{k}") == F.col(f"most_{k}") for k in ranks))
    alone = F.col("last_id") == F.col("lowest_id")  # no other row equals the best in every field
    return found.select("first_id", "copies", (-F.col("top.id")).alias("quote_id"), (whole & alone & F.col("several")).alias("dominant"), F.col("top.trust").alias("trust"))


def best_rows(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """The survivor of each group of copies, with ``dominant`` and its source's ``trust``.

    A null status, highlight or time is the worst of its field; a null or unlisted source name is one unlisted source. A row that repeats entirely is one row, and alone dominates nothing. Empty tables give no rows.
    """
    rows, names = members(quotes, sources)
    return survivors(rows, infer(materialize(claims(rows)), names))


def fused(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """For each group of copies its survivor, and of each field the likeliest value and all values judged true."""
    rows, names = members(quotes, sources)
    facts = materialize(claims(rows))
    quality = infer(facts, names)
    p = quality.posterior(F.col("field"), F.col("covering"), F.col("asserting"))
    values = facts.select("first_id", "field", "value", p.alias("p"))
    shown = [
        column
        for i, name in enumerate(FIELDS)
        for column in (
            F.max(F.when(F.col("field") == i, F.struct("p", "value")))["value"].alias(name),
            F.array_sort(F.collect_set(F.when((F.col("field") == i) & (F.col("p") >= 0.5), F.col("value")))).alias(f"{name}_true"),
        )
    ]
    return survivors(rows, quality).drop("dominant").join(values.groupBy("first_id").agg(*shown), "first_id", "left")
