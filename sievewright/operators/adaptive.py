"""Rounds of retrieval over a table of states, in which only open items ask again.

An item's first round asks for its required roles. One that is insufficient and has no owner yet asks once more for the same; one
with an owner promotes the first deferred objective, in a fixed order, for which something can be asked, and ends behind
it. Each round is one plan over the open items of the stored state, whose evidence grows by what the round found; the loop
ends when no item is open, after three rounds at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

#: The order in which deferred objectives are promoted, the most rounds, and why items stop.
ORDER = ("verification_repro", "diagnostic_surface", "behavior_path", "configuration_context", "usage_contract")
ROUNDS = 3
SUFFICIENT = ("initial_round_sufficient", "owner_recovery_sufficient", "adaptive_round_sufficient")
NO_OWNER_GAIN, NO_GAIN, NOT_GROUNDED, NO_PROMOTION, LIMIT = "partial_no_owner_gain", "partial_no_promoted_evidence_gain", "partial_owner_not_grounded", "partial_no_deferred_promotion", "adaptive_round_limit"

Ask = Callable[[DataFrame], DataFrame]


def next_promotion(deferred: DataFrame, promoted: DataFrame) -> DataFrame:
    """``(item, objective, skipped)`` of ``deferred(item, objective, role, executable)``: the first objective in the fixed order that
    ``promoted(item, promoted)`` doesn't hold and one of whose roles can be asked for, and those before it that can't."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("objective"))
    known = deferred.where((place > 0) & F.col("role").isNotNull()).groupBy("item", "objective").agg(F.max("executable").alias("executable"))
    left = known.join(promoted, "item").where(~F.array_contains("promoted", F.col("objective"))).withColumn("place", place)
    before = left.withColumns({"at": F.min(F.when(F.col("executable"), F.col("place"))).over(Window.partitionBy("item"))})
    return before.groupBy("item").agg(
        F.max(F.when(F.col("place") == F.col("at"), F.col("objective"))).alias("objective"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("at").isNull() | (F.col("place") < F.col("at")), F.struct("place", "objective")))), lambda x: x["objective"]).alias("skipped"),
    )


def _grown(state: DataFrame, found: DataFrame, judge: Ask) -> DataFrame:
    """``state`` with the refs of ``found(item, ref)``, whether these are more than before, and the judgement of all of them."""
    new = found.groupBy(F.col("item").alias("i")).agg(F.collect_set("ref").alias("new"))  # a round's few hits of an item
    j = state.join(new, F.col("item") == F.col("i"), "left").drop("i")
    j = j.withColumn("all", F.array_sort(F.array_union("refs", F.coalesce("new", F.array().cast("array<string>")))))
    j = j.withColumn("gained", F.size("all") > F.size("refs")).withColumn("refs", F.col("all")).drop("all", "new")
    j = stored(j.drop("grounded", "sufficient"), "round")
    said = judge(j.select("item", F.explode("refs").alias("ref"))).select(F.col("item").alias("i"), "grounded", "sufficient")
    out = j.join(said, F.col("item") == F.col("i"), "left").drop("i")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("grounded", "sufficient")})


def run_rounds(items: DataFrame, deferred: DataFrame, first: Ask, recover: Ask, promote: Ask, judge: Ask) -> DataFrame:
    """``(item, rounds, stop, promoted, refs, counts)``: how each of ``items(item)`` ended, with its sorted refs and how many it had
    after each round.

    ``first``, ``recover`` and ``promote`` take the open items (``promote`` with their ``objective``) and give hits ``(item, ref)``;
    ``judge`` takes all refs ``(item, ref)`` and gives ``(item, grounded, sufficient)``. Repeated items are one.
    """
    none = F.array().cast("array<string>")
    state = items.select("item").distinct().select("item", none.alias("refs"), none.alias("promoted"), F.array().cast("array<int>").alias("counts"), F.lit(None).cast("string").alias("objective"))

    def closed(s: DataFrame, stop: Column) -> DataFrame:
        return stored(s.withColumns({"counts": F.concat("counts", F.array(F.size("refs"))), "stop": stop}).drop("gained"), "state")

    def advance(s: DataFrame, ask: Ask, open_: Column, stop: Column) -> DataFrame:
        """Open items ask and are judged anew; the others stay as they are."""
        now = s.where(open_)
        if not now.limit(1).collect():
            return s
        return stored(s.where(~open_).unionByName(closed(_grown(now, ask(now), judge), stop)), "state")

    state = closed(_grown(state, first(state), judge), F.when(F.col("sufficient"), SUFFICIENT[0]))
    is_open = F.col("stop").isNull()
    state = advance(state, recover, is_open & ~F.col("grounded"), F.when(F.col("sufficient"), SUFFICIENT[1]).when(~F.col("gained") & ~F.col("grounded"), NO_OWNER_GAIN))
    state = state.withColumn("stop", F.when(is_open & ~F.col("grounded"), NOT_GROUNDED).otherwise(F.col("stop")))
    chosen = next_promotion(deferred, state.where(is_open).select("item", "promoted")).withColumnRenamed("objective", "next")
    state = state.join(chosen, "item", "left")
    promoted = F.array_distinct(F.concat("promoted", F.coalesce("skipped", none), F.when(F.col("next").isNotNull(), F.array("next")).otherwise(none)))
    state = state.withColumns({"promoted": F.when(is_open, promoted).otherwise(F.col("promoted")), "objective": F.col("next")}).drop("next", "skipped")
    state = stored(state.withColumn("stop", F.when(is_open & F.col("objective").isNull(), NO_PROMOTION).otherwise(F.col("stop"))), "state")
    state = advance(state, promote, is_open, F.when(F.col("sufficient"), SUFFICIENT[2]).when(~F.col("gained"), NO_GAIN).otherwise(LIMIT))
    return state.select("item", F.size("counts").alias("rounds"), "stop", "promoted", "refs", "counts")
