"""The best representative of each group of duplicate responses (problem 4).

Members of a group answer for one series and range. For each field the values that
its members have are put into a partial order of currency, and the survivor's
value is a topologically latest one:

* of two dated values the one received later is later;
* where a time is missing, precedence of values is learned. In each group the
  dated values of a field, in order of the last time they were received, vote:
  each change from a to b speaks for "b follows a". Over all groups these votes
  make a graph, and a precedes b if the strongest path from a to b (its strength
  is its weakest link) is stronger than the one back. This relation (Schulze's) is
  transitive and has no cycles, whatever the votes;
* `undated="earliest"` sets the place of undated members instead: before all dated ones.

A value that nothing follows is latest. Where times and learned precedence go round
in a circle, the value is taken that the weakest evidence speaks against. What the
order leaves open is decided by completeness (for `vals`), the time, the trust in
the server, and the smallest response_id.

Everything is a hash aggregate over (group, field) with partial aggregation before
the exchange, so a group of any size is reduced to its distinct values where it is
read; these meet the learned pairs in joins, and no list of a group is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.responses import canonical_name, present
from ..session import checkpoint

FIELDS = ("vals", "path_expr", "cons_func", "xff")
LEARNED = ("path_expr", "cons_func", "xff")
_LAST_RANK = 2**31 - 1
_HOUR = 3600


def server_key(c: Column) -> Column:
    """A server's name in lower case without port and white space at the ends."""
    return F.lower(F.trim(F.regexp_replace(F.trim(c), r":\d+$", "")))


def own_present(vals: str = "vals") -> Column:
    """How many values are present before the response's own stop."""
    fits = F.when(
        (F.col("step") > 0) & (F.col("stop") > F.col("start")), F.ceil((F.col("stop") - F.col("start")) / F.col("step"))
    ).otherwise(F.lit(0))
    n = F.least(F.size(vals).cast("long"), fits.cast("long"))
    held = F.when(n > 0, F.slice(vals, F.lit(1), n.cast("int")))
    return F.coalesce(F.size(F.filter(held, present)), F.lit(0))


def members(responses: DataFrame, servers: DataFrame) -> DataFrame:
    """One slim row per response: its group's key, what it offers for each field, and what orders it.

    `vals` itself is not carried; its present values are counted in the scan.
    """
    ranks = servers.where(F.col("server").isNotNull()).groupBy(server_key(F.col("server")).alias("server_key")).agg(F.min("trust_rank").alias("rank"))
    slim = responses.where(F.col("response_id").isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull()).select(
        "response_id",
        canonical_name("name").alias("name"),
        F.floor(F.col("start") / _HOUR).cast("long").alias("h0"),
        F.floor(F.col("stop") / _HOUR).cast("long").alias("h1"),
        server_key(F.col("server")).alias("server_key"),
        F.unix_micros(F.col("received_at").cast("timestamp")).alias("at"),
        F.when(own_present() > 0, own_present()).alias("n_present"),
        "path_expr",
        "cons_func",
        F.when(present(F.col("xff")), F.col("xff")).alias("xff"),
    )
    known = slim.where(F.col("name").isNotNull()).join(ranks, "server_key", "left")
    return known.withColumn("rank", F.coalesce("rank", F.lit(_LAST_RANK))).drop("server_key")


def _groups(m: DataFrame) -> DataFrame:
    keys = ["name", "h0", "h1"]
    sizes = m.groupBy(*keys).agg(F.min("response_id").alias("group_id"), F.count(F.lit(1)).alias("members"))
    return sizes.where(F.col("members") >= 2)


def value_votes(best: DataFrame) -> DataFrame:
    """`field, a, b, votes long`: in how many groups b came next after a, from the last times of the values of each group."""
    dated = best.where(F.col("last").isNotNull() & F.col("value").isNotNull()).select("group_id", "field", "value", "last")
    # of values received at one time none comes after the other
    alone = dated.groupBy("group_id", "field", "last").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("k")).where("k = 1")
    w = Window.partitionBy("group_id", "field").orderBy("last")  # one row per distinct value of a group
    steps = alone.select("field", F.col("value").alias("a"), F.lead("value").over(w).alias("b")).where(F.col("b").isNotNull())
    return steps.groupBy("field", "a", "b").agg(F.count(F.lit(1)).alias("votes"))


def precedence(votes: DataFrame, rounds: int = 20) -> DataFrame:
    """`field, a, b, strength`: which values precede which, by the strongest paths of votes.

    Paths double in length each round until nothing gets stronger; a round is a
    join of pairs of values, of which there are few next to rows.
    """
    back = votes.select("field", F.col("a").alias("b"), F.col("b").alias("a"), F.col("votes").alias("against"))
    won = votes.join(back, ["field", "a", "b"], "left").where(F.col("votes") > F.coalesce("against", F.lit(0)))
    paths = checkpoint(won.select("field", "a", "b", F.col("votes").alias("strength")))
    state = paths.agg(F.count(F.lit(1)), F.sum("strength")).first()
    for _ in range(rounds):
        on = paths.select("field", F.col("a").alias("m"), F.col("b").alias("c"), F.col("strength").alias("s2"))
        longer = paths.withColumnRenamed("b", "m").join(on, ["field", "m"]).where(F.col("a") != F.col("c")).select("field", "a", F.col("c").alias("b"), F.least("strength", "s2").alias("strength"))
        paths = checkpoint(paths.unionByName(longer).groupBy("field", "a", "b").agg(F.max("strength").alias("strength")))
        now = paths.agg(F.count(F.lit(1)), F.sum("strength")).first()
        if now == state:
            break
        state = now
    back = paths.select("field", F.col("a").alias("b"), F.col("b").alias("a"), F.col("strength").alias("against"))
    return paths.join(back, ["field", "a", "b"], "left").where(F.col("strength") > F.coalesce("against", F.lit(0))).select("field", "a", "b", "strength")


_CERTAIN = 2**62


def _evidence(best: DataFrame, order: DataFrame) -> DataFrame:
    """Adds `against`: the strongest evidence that another value of the group is later; a later time is certain."""
    keys = ["group_id", "field"]
    # only where a time is missing and there are several values can learned precedence say anything
    open_ = best.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.count("last").alias("dated"), F.max("last").alias("newest"))
    mixed = open_.where((F.col("k") > 1) & (F.col("dated") < F.col("k"))).select(*keys)
    asked = best.join(mixed, keys, "left_semi").select(*keys, "value", "last")
    x = asked.withColumnRenamed("value", "a").join(order, ["field", "a"])
    y = asked.select(*keys, F.col("value").alias("b"), F.col("last").alias("other"))
    learned = x.join(y, [*keys, "b"]).where(F.col("last").isNull() | F.col("other").isNull()).groupBy(*keys, F.col("a").alias("value")).agg(F.max("strength").alias("learned"))
    known = best.join(learned, [*keys, "value"], "left").join(open_.select(*keys, "newest"), keys, "left")
    return known.withColumn("against", F.when(F.col("last") < F.col("newest"), F.lit(_CERTAIN)).otherwise(F.coalesce("learned", F.lit(0))))


def choose(m: DataFrame, undated: str = "learned") -> DataFrame:
    """`group_id, field, response_id, value`: the member each field is taken from, and its value as text (null for `vals`)."""
    if undated not in ("learned", "earliest"):
        raise ValueError("undated is 'learned' or 'earliest'")
    g = m.join(_groups(m), ["name", "h0", "h1"])
    # the larger, the later: time (undated first), then trust, then the smaller id; completeness goes before all for vals
    currency = F.struct(
        F.coalesce("at", F.lit(-(2**63) + 1)).alias("at"), (-F.col("rank")).alias("trust"), (-F.col("response_id")).alias("neg_id")
    )
    offers = F.array(
        F.struct(F.lit("vals").alias("field"), F.lit(None).cast("string").alias("value"), F.col("n_present").cast("long").alias("full")),
        *(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.when(F.col(f).isNotNull(), F.lit(0)).cast("long").alias("full")) for f in LEARNED),
    )
    each = g.select("group_id", "at", currency.alias("key"), F.explode(offers).alias("o")).where(F.col("o.full").isNotNull())
    best = (
        each.groupBy("group_id", F.col("o.field").alias("field"), F.col("o.value").alias("value"))
        .agg(F.max(F.struct(F.col("o.full"), F.col("key"))).alias("top"), F.max("at").alias("last"))
    )
    against = F.lit(0)
    if undated == "learned":
        best = checkpoint(best)
        best, against = _evidence(best, precedence(value_votes(best))), -F.col("against")
    picked = best.groupBy("group_id", "field").agg(F.max(F.struct(F.col("top.full"), against.cast("long").alias("for"), F.col("top.key"), F.col("value"))).alias("order"))
    return picked.select("group_id", "field", (-F.col("order.key.neg_id")).alias("response_id"), F.col("order.value").alias("value"))


def survivors(responses: DataFrame, servers: DataFrame, undated: str = "learned") -> DataFrame:
    """`group_id, field, response_id` of all groups of two or more responses.

    A group is one series (same path nodes and tags) with `start` and `stop`, each
    taken down to the full hour, equal; `group_id` is its smallest response_id.
    `vals` come from the member with the most present values before its own stop;
    of equals, and for the other fields among the members that have them, the
    order of currency decides, then trust, then the smallest id. A field no
    member has gives no row. Null names, starts, stops or ids belong to no group;
    unknown or null servers are trusted least; NaN counts as null. A repeated
    response_id counts as one member more.
    """
    return choose(members(responses, servers), undated).drop("value")


def surviving_records(responses: DataFrame, servers: DataFrame, undated: str = "learned") -> DataFrame:
    """One record per group: `group_id, name, start, stop, step, vals, path_expr, cons_func, xff`.

    `start`, `stop` and `step` are those of the member the values come from, or
    of the group's first member where no member has a value.
    """
    picked = choose(members(responses, servers), undated)
    values = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in LEARNED]
    wide = picked.groupBy("group_id").agg(F.max(F.when(F.col("field") == "vals", F.col("response_id"))).alias("vals_id"), *values)
    wide = wide.withColumn("response_id", F.coalesce("vals_id", "group_id"))
    # only the picked responses' values are moved
    frames = responses.select("response_id", canonical_name("name").alias("name"), "start", "stop", "step", "vals").join(wide, "response_id").dropDuplicates(["group_id"])
    return frames.select(
        "group_id", "name", "start", "stop", "step", F.when(F.col("vals_id").isNotNull(), F.col("vals")).alias("vals"),
        *(F.col(f).cast("double" if f == "xff" else "string").alias(f) for f in LEARNED),
    )
