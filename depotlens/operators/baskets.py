"""The basket as a fold of a keyed event table.

Events: ``(seq, session_id, material_number, op, quantity, unit_price
[, description])`` with op in add / set / confirm, applied per
(session, material) in ``seq`` order:

* add     -- new key: store qty, price, description; existing: qty += q
             (the first price and description stay).                (B1)
* set     -- existing key: q > 0 replaces qty, q <= 0 deletes;
             unknown key: no effect.                                 (B2)
* confirm -- deletes the key.                                        (B3)

B4 (current basket) is computed with aggregations only, so a hot key is
partially aggregated on the map side instead of landing whole in one task:

1. per key: R = last removal (set q<=0 or confirm), LS/LSQ = last positive
   set and its quantity;
2. add events after R, per key: FA = first add, its price/description,
   sum of adds, sum of adds after LS.
3. present iff an add follows R; qty = LSQ + adds after LS when LS > FA,
   else the sum of adds after R.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depotlens.functions.rounding import round_half_even

KEY = ["session_id", "material_number"]


def _removal():
    return (F.col("op") == "confirm") | ((F.col("op") == "set") & (F.coalesce("quantity", F.lit(0)) <= 0))


def _positive_set():
    return (F.col("op") == "set") & (F.col("quantity") > 0)


def basket_current(events: DataFrame) -> DataFrame:
    """The basket after all events: one row per live (session, material)."""
    ev = events if "description" in events.columns else events.withColumn("description", F.lit(None).cast("string"))
    last = ev.groupBy(*KEY).agg(
        F.max(F.when(_removal(), F.col("seq"))).alias("R"),
        F.max(F.when(_positive_set(), F.col("seq"))).alias("LS"),
        F.max_by(F.when(_positive_set(), F.col("quantity")), F.when(_positive_set(), F.col("seq"))).alias("LSQ"))
    adds = ev.where(F.col("op") == "add").join(last, KEY, "left").where(
        F.col("R").isNull() | (F.col("seq") > F.col("R")))
    agg = adds.groupBy(*KEY).agg(
        F.min("seq").alias("FA"),
        F.min_by("unit_price", "seq").alias("unit_price"),
        F.min_by("description", "seq").alias("description"),
        F.sum("quantity").alias("adds_all"),
        F.sum(F.when(F.col("LS").isNotNull() & (F.col("seq") > F.col("LS")), F.col("quantity")).otherwise(0))
         .alias("adds_after_ls"),
        F.first("LS").alias("LS"), F.first("LSQ").alias("LSQ"))
    qty = F.when(F.col("LS").isNotNull() & (F.col("LS") > F.col("FA")), F.col("LSQ") + F.col("adds_after_ls")) \
        .otherwise(F.col("adds_all"))
    return agg.select(*KEY, qty.cast("long").alias("quantity"), "unit_price", "description",
                      (qty * F.col("unit_price")).alias("total"))


def basket_totals(basket: DataFrame) -> DataFrame:
    """Distinct items and total value per session."""
    return basket.groupBy("session_id").agg(
        F.count(F.lit(1)).cast("long").alias("items"),
        round_half_even(F.sum(F.col("total").cast("decimal(38,10)")).cast("double"), 2).alias("total_value"))


#: Sequence numbers per block of the order-line fold: at most so many events of one key meet in one task.
BLOCK_SEQS = 100_000


def _block_states(events: DataFrame, block_seqs: int) -> DataFrame:
    """What each confirm, and the end of each (key, block), finds when only the block's own events count.

    ``cut``: the block removed the line before this row, so what came before the block no longer matters.
    ``own_*``: the line that the block's events alone leave.  ``set_qty`` / ``adds``: what they make of a line that
    was there before the block: the last positive set plus the adds after it, or that many more.
    """
    cols = [*KEY, "seq", "op", "quantity", "unit_price"]
    ev = events.select(*cols).withColumn("block", F.floor(F.col("seq") / F.lit(block_seqs)))
    ends = ev.select(*KEY, "block").distinct().select(
        *KEY, F.lit(None).cast("long").alias("seq"), F.lit("end").alias("op"), F.lit(None).cast("long").alias("quantity"),
        F.lit(None).cast("double").alias("unit_price"), "block")
    ev = ev.withColumn("seq", F.col("seq").cast("long")).withColumn("quantity", F.col("quantity").cast("long")).unionByName(ends)
    w = Window.partitionBy(*KEY, "block").orderBy(F.col("seq").asc_nulls_last())
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    is_add = F.col("op") == "add"

    def before(column) -> F.Column:
        return F.last(column, ignorenulls=True).over(prev)

    s1 = ev.select("*", F.coalesce(F.sum(F.when(is_add, F.col("quantity"))).over(prev), F.lit(0)).alias("ca"),
                   F.count(F.when(is_add, 1)).over(prev).alias("na"), _removal().alias("rem"), _positive_set().alias("pset"))
    s2 = s1.select(
        "*", before(F.when(F.col("rem"), F.col("seq"))).alias("R"), before(F.when(F.col("rem"), F.col("ca"))).alias("ca_R"),
        before(F.when(F.col("rem"), F.col("na"))).alias("na_R"), before(F.when(F.col("pset"), F.col("seq"))).alias("LS"),
        before(F.when(F.col("pset"), F.col("quantity"))).alias("LSQ"), before(F.when(F.col("pset"), F.col("ca"))).alias("ca_LS"))
    first_add = is_add & (F.col("na") == F.coalesce("na_R", F.lit(0)))
    s3 = s2.withColumn("first_add", first_add)
    s4 = s3.select("*", before(F.when(F.col("first_add"), F.col("seq"))).alias("FA"),
                   before(F.when(F.col("first_add"), F.col("unit_price"))).alias("FA_price"))
    after_set = F.col("LSQ") + F.col("ca") - F.col("ca_LS")
    own = F.when(F.col("LS") > F.col("FA"), after_set).otherwise(F.col("ca") - F.coalesce("ca_R", F.lit(0)))
    return s4.where(F.col("op").isin("confirm", "end")).select(
        *KEY, "block", "seq", F.col("R").isNotNull().alias("cut"), (F.col("na") > F.coalesce("na_R", F.lit(0))).alias("own_live"),
        own.cast("long").alias("own_qty"), F.col("FA_price").alias("own_price"), after_set.cast("long").alias("set_qty"), F.col("ca").cast("long").alias("adds"))


def _apply(state, x):
    """The line after ``x``'s events, given the line before its block (struct live, qty, price)."""
    own = x["cut"] | ~state["live"]
    return F.struct(
        F.when(own, x["own_live"]).otherwise(F.lit(True)).alias("live"),
        F.when(own, x["own_qty"]).otherwise(F.coalesce(x["set_qty"], state["qty"] + x["adds"])).alias("qty"),
        F.when(own, x["own_price"]).otherwise(state["price"]).alias("price"))


def _lines_at_block_starts(blocks: DataFrame) -> DataFrame:
    """(key, block, was): the line that each block begins with, by running windows over the key's block summaries.

    An epoch begins with a block that cuts.  In it the first block whose own events leave a line is the base; later blocks set or add to that line.
    """
    in_key = Window.partitionBy(*KEY).orderBy("block")
    upto = Window.partitionBy(*KEY, "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.withColumn("epoch", F.sum(F.col("cut").cast("int")).over(in_key.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("base", F.first(F.when(F.col("own_live"), F.struct("block", "own_qty", "own_price")), ignorenulls=True).over(upto))
    later = F.coalesce(F.col("block") > F.col("base.block"), F.lit(False))
    b = b.withColumn("added", F.sum(F.when(later, F.col("adds")).otherwise(0)).over(upto))
    b = b.withColumn("set", F.last(F.when(later & F.col("set_qty").isNotNull(), F.struct("set_qty", "added")), ignorenulls=True).over(upto))
    qty = F.when(F.col("set").isNotNull(), F.col("set.set_qty") + F.col("added") - F.col("set.added")).otherwise(F.col("base.own_qty") + F.col("added"))
    line = F.struct(F.col("base").isNotNull().alias("live"), qty.cast("long").alias("qty"), F.col("base.own_price").alias("price"))
    nothing = F.struct(F.lit(False).alias("live"), F.lit(None).cast("long").alias("qty"), F.lit(None).cast("double").alias("price"))
    return b.select(*KEY, "block", F.coalesce(F.lag(line).over(in_key), nothing).alias("was"))


def order_lines(events: DataFrame, assigned: DataFrame, block_seqs: int = BLOCK_SEQS) -> DataFrame:
    """Every confirm that finds a live line becomes an order line with the
    line as it stood just before the confirm, its vendor and a deterministic
    order id ``substr(sha2(session|vendor|seq), 1, 8)``.

    The line before a confirm is a prefix fold over the key's events.  Events are cut into blocks by ``seq``; each (key, block) is folded
    by itself (window frames over at most ``block_seqs`` events) to a summary that composes, the summaries of a key are folded in
    order, and each confirm is finished from the line that its block began with.  So a hot key's events spread over as many tasks as it has blocks.
    """
    rows = _block_states(events, block_seqs)
    fields = ["block", "cut", "own_live", "own_qty", "own_price", "set_qty", "adds"]
    began = _lines_at_block_starts(rows.where(F.col("seq").isNull()).select(*KEY, *fields))
    confirms = rows.where(F.col("seq").isNotNull()).join(began, [*KEY, "block"])
    x = {c: F.col(c) for c in fields}
    conf = confirms.select(*KEY, "seq", _apply(F.col("was"), x).alias("line")).where("line.live").select(
        *KEY, "seq", F.col("line.qty").alias("quantity"), F.col("line.price").alias("unit_price"))
    j = conf.join(assigned.select("material_number", "vendor"), "material_number", "left")
    oid = F.substring(F.sha2(F.concat_ws("|", F.col("session_id").cast("string"), F.coalesce("vendor", F.lit("")),
                                         F.col("seq").cast("string")), 256), 1, 8)
    return j.select(oid.alias("order_id"), "session_id", "vendor", "material_number", "seq", "quantity",
                    "unit_price", round_half_even(F.col("quantity") * F.col("unit_price"), 2).alias("total"))


def confirm_error(vendor, n_lines):
    """Why a confirm request is refused, null if it is not: it must name a vendor and hold a line."""
    named = F.coalesce(F.trim(vendor) != "", F.lit(False))
    return F.when(~named, F.lit("no vendor")).when(F.coalesce(n_lines, F.lit(0)) <= 0, F.lit("no lines"))


def bulk_confirm_summary(requests: DataFrame) -> DataFrame:
    """Per session, confirm requests (vendor, n_lines) that go through and those
    refused by the rule of B3; each is judged by itself."""
    error = confirm_error(F.col("vendor"), F.col("n_lines"))
    return requests.groupBy("session_id").agg(
        F.count(F.when(error.isNull(), 1)).cast("long").alias("succeeded"),
        F.count(error).cast("long").alias("failed"))


def auto_basket(predictions: DataFrame) -> DataFrame:
    """Proposed basket lines for every cart-eligible material."""
    return predictions.where(F.coalesce("add_to_cart_eligible", F.lit(False))).select(
        "material_number", F.col("order_quantity").alias("quantity"), "unit_price", "description")
