"""Quotas over rolling windows, usage statistics, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import DAY, GLOBAL_CAP, IP_CAP, PREMIUM_CAP, PREMIUM_WINDOW, PRICES, USD_CNY, VISITOR_CAP


def epoch(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000000).cast("long")


def short_hash(text: Column) -> Column:
    return F.when(text != "", F.substring(F.sha2(text, 256), 1, 16))


def usage_rows(events: DataFrame) -> DataFrame:
    """(event_id, key, ts) for each use: the whole site, the address' hash, and the visitor if there is one.

    events(event_id, ts long, visitor, ip).
    """
    keys = F.array_compact(F.array(F.lit("global"), F.concat(F.lit("ip:"), short_hash(F.col("ip"))), F.concat(F.lit("vid:"), F.nullif("visitor", F.lit("")))))
    return events.select("event_id", F.explode(keys).alias("key"), "ts")


def rolling_count(usage: DataFrame, window: int, inclusive: bool = True, own: bool = True) -> DataFrame:
    """``usage`` with ``used``: rows of the key in the window up to each row's second, those of that second included if ``own``.

    A row is in the slot of its time, and once more, as an echo, in the next slot at the time from which it no longer
    counts.  Of a slot's echoes those that are still to come count, with the rows so far: running sums, whose cost grows
    with the rows and not with the rows in a window.  A hot key is split by time, and no task holds more of it than two windows' rows.
    """
    span = window + 1 if inclusive else window
    slot = F.floor(F.col("ts") / span)
    echo = F.struct((slot + 1).alias("slot"), (F.col("ts") + span).alias("at"), F.lit(1).alias("echo"))
    home = F.struct(slot.alias("slot"), F.col("ts").alias("at"), F.lit(0).alias("echo"))
    rows = usage.withColumn("_w", F.explode(F.when(F.col("ts").isNull(), F.array(home)).otherwise(F.array(home, echo))))
    whole = Window.partitionBy("key", "_w.slot")
    sofar = whole.orderBy("_w.at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = sofar if own else whole.orderBy("_w.at").rangeBetween(Window.unboundedPreceding, -1)
    used = F.sum(1 - F.col("_w.echo")).over(before)
    left = F.sum("_w.echo").over(whole) - F.sum("_w.echo").over(sofar)
    return rows.withColumn("used", F.coalesce(used, F.lit(0)) + left).where("_w.echo = 0").drop("_w")


def quota_check(events: DataFrame) -> DataFrame:
    """Decision for each event, given all uses in the 24 hours before its second: event_id, reason, remaining.

    The site's cap comes first, then the visitor's, then the address'.  Uses count whether or not
    they would have been admitted (``scholia.streaming.usage`` admits one by one).
    """
    before = rolling_count(usage_rows(events), DAY, own=False).withColumnRenamed("used", "n")  # uses in the event's own second come after it
    kind = F.when(F.col("key") == "global", "g").when(F.startswith("key", F.lit("vid:")), "v").otherwise("i")
    wide = before.withColumn("kind", kind).groupBy("event_id").agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in "gvi"])
    reason = F.when(F.col("g") >= GLOBAL_CAP, "global").when(F.col("v") >= VISITOR_CAP, "visitor").when(F.col("i") >= IP_CAP, "ip").otherwise("ok")
    left = F.when(reason == "ok", F.greatest(F.lit(0), F.lit(VISITOR_CAP) - F.col("v"))).otherwise(F.lit(0))
    return wide.select("event_id", reason.alias("reason"), left.cast("long").alias("remaining"))


def retained(usage: DataFrame, now: int | Column, window: int = DAY) -> DataFrame:
    return usage.where(F.col("ts") >= now - window)


def window_status(usage: DataFrame, now: int | Column, limit: int = PREMIUM_CAP, window: int = PREMIUM_WINDOW) -> DataFrame:
    """Per key: used, remaining, can_use, locked_until, next_recover, full_reset in an exclusive window."""
    live = usage.where(F.lit(now) - F.col("ts") < window).groupBy("key").agg(F.count(F.lit(1)).alias("used"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    return live.select(
        "key",
        "used",
        F.greatest(F.lit(0), F.lit(limit) - F.col("used")).cast("long").alias("remaining"),
        (F.col("used") < limit).alias("can_use"),
        F.when(F.col("used") >= limit, F.col("low") + window).alias("locked_until"),
        (F.col("low") + window).alias("next_recover"),
        (F.col("high") + window).alias("full_reset"),
    )


def cost(engine: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Estimated cost in CNY; an unknown engine costs what flash does."""
    price = lambda k: F.when(engine == "v4pro", F.lit(PRICES["v4pro"][k])).otherwise(F.lit(PRICES["flash"][k]))
    usd = F.coalesce(tokens_in, F.lit(0)) / F.lit(1e6) * price(0) + F.coalesce(tokens_out, F.lit(0)) / F.lit(1e6) * price(1)
    return F.round(usd * F.lit(USD_CNY), 6)


def usage_stats(usage: DataFrame, costs: DataFrame, waitlist: DataFrame, now: int | Column, window: int = DAY) -> DataFrame:
    """One row: analyses, visitors, tokens, calls, costs and new waiting addresses in the window."""
    since = now - window
    u = usage.where(F.col("ts") >= since).agg(F.count_if(F.col("key") == "global").alias("analyses"), F.count_distinct(F.when(F.startswith("key", F.lit("vid:")), F.col("key"))).alias("unique_visitors"))
    c = costs.where(F.col("ts") >= since).agg(
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.round(F.coalesce(F.sum("est_cost_cny"), F.lit(0.0)), 4).alias("est_cost_cny"),
        F.count(F.lit(1)).alias("cost_calls"),
    )
    c = c.withColumn("avg_cost_cny", F.when(F.col("cost_calls") > 0, F.round(F.col("est_cost_cny") / F.col("cost_calls"), 4)).otherwise(F.lit(0.0)))
    w = waitlist.agg(F.count_if(F.col("created_at") >= since).alias("waitlist_new"), F.count(F.lit(1)).alias("waitlist_total"))
    return u.crossJoin(c).crossJoin(w)  # three single rows


def email_valid(email: Column) -> Column:
    clean = F.lower(F.trim(email))
    return F.rlike(clean, F.lit(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")) & (F.length(clean) <= 200)


def visitor_valid(visitor: Column) -> Column:
    return F.rlike(visitor, F.lit("^[0-9a-f]{32}$"))


def first_address(forwarded: Column) -> Column:
    return F.trim(F.split(forwarded, ",")[0])
