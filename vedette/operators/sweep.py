"""Sliding time windows over hot keys.

Spark evaluates a moving RANGE frame by re-reading the frame for every row, which is
quadratic in the events of one window, and a window keyed by attacker alone puts a hot
attacker into one task. Both go away with a sweep:

* every event becomes an *enter* row at its time and a *leave* row when it drops out of
  the window, so each measure of the window is a running sum;
* time is cut into chunks no shorter than the window. An event alive across a chunk
  border also enters the next chunk (at its own time, hence before all rows there), so
  each (key, chunk) is computed alone and exactly.

Rows grow at most threefold; the wide columns travel on the event row only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions.numeric import US, div_us, round_to
from ..functions.text import auth_flags

AT, SIGN, CHUNK, EVENT, ROW = "_at", "_sign", "_chunk", "_event", "_row"


def live_rows(df: DataFrame, keep: Sequence[str], ts: str, width_us: int, inclusive: bool = False,
              delay_us: int = 0, chunk_us: int | None = None) -> DataFrame:
    """Enter and leave rows of the window (t - width, t], or [t - width, t] if inclusive.

    ``keep`` columns are on every row; all columns are in the struct ``_row`` of event
    rows. With ``delay_us`` an event becomes visible only that long after its own time.
    """
    t = F.col(ts)
    start = t + F.lit(delay_us)
    leave = t + F.lit(width_us + (1 if inclusive else 0))
    size = max(chunk_us or 0, width_us + delay_us + 2)
    c, first, last = div_us(t, size), div_us(start, size), div_us(leave, size)

    def row(chunk, at, sign, event):
        return F.struct(chunk.alias(CHUNK), at.alias(AT), F.lit(sign).cast("bigint").alias(SIGN),
                        F.lit(event).alias(EVENT))

    rows = [row(c, t, 0 if delay_us else 1, True), row(last, leave, -1, False),
            F.when(last != first, row(last, start, 1, False))]
    if delay_us:
        rows.append(row(first, start, 1, False))
    payload = F.struct(*[F.col(f"`{x}`") for x in df.columns])
    kept = list(dict.fromkeys(keep))
    return (
        df.select(*kept, payload.alias("_all"), F.explode(F.array_compact(F.array(*rows))).alias("_x"))
        .select(*kept, f"_x.{CHUNK}", f"_x.{AT}", f"_x.{SIGN}", f"_x.{EVENT}",
                F.when(F.col(f"_x.{EVENT}"), F.col("_all")).alias(ROW))
    )


#: Window tasks per shuffle partition of the session.
FINE = 8


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows by (key, chunk), in many small tasks: a task sorts all its rows, wide ones too."""
    return rows.repartition(FINE * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, CHUNK)


def so_far(*keys: str) -> Window:
    """Running frame that includes rows of the same time."""
    return (Window.partitionBy(*keys, CHUNK).orderBy(AT)
            .rangeBetween(Window.unboundedPreceding, Window.currentRow))


def step_by_step(*keys: str) -> Window:
    """Running frame row by row, for telescoping sums whose order within one time is free."""
    return (Window.partitionBy(*keys, CHUNK).orderBy(AT)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def live_counts(df: DataFrame, keys: Sequence[str], ts: str, width_us: int, measures: Mapping[str, str],
                inclusive: bool = False) -> DataFrame:
    """Adds one window sum per measure: output name -> BIGINT column to sum."""
    rows = live_rows(df, [*keys, *measures.values()], ts, width_us, inclusive)
    w = so_far(*keys)
    sums = {out: F.sum(F.col(SIGN) * F.coalesce(F.col(c), F.lit(0))).over(w) for out, c in measures.items()}
    return rows.withColumns(sums).where(EVENT).select(f"{ROW}.*", *measures)


def activity(df: DataFrame, keys: Sequence[str], ts: str, tie: str, width_us: int = 60 * US,
             lookback_us: int = 3600 * US, count_as: str = "per_minute", prev_as: str = "prev_us") -> DataFrame:
    """Events in (t - width, t] and the time of the previous event within the look-back.

    Both come from one shuffle: chunks are as long as the look-back, and each chunk is
    told the last time of the chunk before by one extra row.
    """
    keys = list(keys)
    size = max(lookback_us, width_us + 2)
    tied = df.withColumn("_tie", F.col(tie))
    rows = live_rows(tied, [*keys, "_tie"], ts, width_us, chunk_us=size)
    border = df.groupBy(*keys, div_us(F.col(ts), size).alias(CHUNK)).agg(F.max(ts).alias(AT)).select(
        *keys, (F.col(CHUNK) + 1).alias(CHUNK), AT, F.lit(0).cast("bigint").alias(SIGN), F.lit(False).alias(EVENT))
    rows = dealt(rows.unionByName(border, allowMissingColumns=True), *keys)
    past = (Window.partitionBy(*keys, CHUNK).orderBy(AT, F.col("_tie").asc_nulls_first())
            .rowsBetween(Window.unboundedPreceding, -1))
    seen = F.last(F.when(F.col(SIGN) >= 0, F.col(AT)), ignorenulls=True).over(past)
    out = rows.withColumns({count_as: F.sum(SIGN).over(so_far(*keys)), prev_as: seen}).where(EVENT)
    near = F.when(F.col(AT) - F.col(prev_as) <= lookback_us, F.col(prev_as))
    return out.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in df.columns], count_as, near.alias(prev_as))


IP = "_ip"


def address_key(ip: str, ts: str) -> Column:
    """The address as a window key. Rows without one need no window: each instant is a key of its own."""
    return F.when(F.coalesce(F.col(ip), F.lit("")) != "", F.col(ip)).otherwise(
        F.concat(F.lit("\0"), F.col(ts).cast("string")))


def correlate(events: DataFrame, client: str = "client_id", window_s: int = rules.CORRELATION_WINDOW_S) -> DataFrame:
    """Attack pattern of each event from its (client, src_ip) history of six minutes.

    Adds correlation_pattern, correlation_count, correlation_events and correlation_delta.
    Events without an address have no history. ``threat_intel`` is used when present.

    How many assets have a failure (or a success, or a failure without a success) in the
    window is a running sum as well: each per-asset counter reports when it becomes or
    stops being positive.
    """
    flagged = events.withColumns(auth_flags("event_type")).withColumn(IP, address_key("src_ip", "ts_us"))
    keep = [client, IP, "asset_id", "event_id", "is_failure", "is_success", "is_blocked"]
    rows = dealt(live_rows(flagged, keep, "ts_us", window_s * US, inclusive=True), client, IP)
    sign = F.col(SIGN)
    fail, succ = sign * F.col("is_failure").cast("bigint"), sign * F.col("is_success").cast("bigint")
    here, run = so_far(client, IP, "asset_id"), step_by_step(client, IP, "asset_id")
    rows = rows.withColumns({
        "_f": F.sum(fail).over(here), "_s": F.sum(succ).over(here),
        "_fa": F.sum(fail).over(run), "_sa": F.sum(succ).over(run),
    }).withColumns({"_fb": F.col("_fa") - fail, "_sb": F.col("_sa") - succ})

    def turned(after, before):
        return after.cast("bigint") - before.cast("bigint")

    fa, fb, sa, sb = (F.col(c) for c in ("_fa", "_fb", "_sa", "_sb"))
    ip = so_far(client, IP)
    before = (Window.partitionBy(client, IP, CHUNK).orderBy(AT, "event_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({
        "_nf": F.sum(turned(fa > 0, fb > 0)).over(ip),
        "_ns": F.sum(turned(sa > 0, sb > 0)).over(ip),
        "_nx": F.sum(turned((fa > 0) & (sa == 0), (fb > 0) & (sb == 0))).over(ip),
        "_blocked": F.sum(sign * F.col("is_blocked").cast("bigint")).over(ip),
        "_n": F.sum(sign).over(ip),
        "_prev": F.last(F.when(sign > 0, F.col(AT)), ignorenulls=True).over(before),
    }).where(EVENT)
    known = F.coalesce(F.col(f"{ROW}.src_ip"), F.lit("")) != ""
    intel = F.coalesce(F.col(f"{ROW}.threat_intel"), F.lit(False)) if "threat_intel" in events.columns else F.lit(False)
    f = F.col("_f")
    gap = F.col(AT) - F.col("_prev")
    steps = [
        (intel, "c2_beacon", F.lit(1)),
        (known & (F.col("_ns") > 0) & (F.col("_nx") > 0), "lateral_movement", F.col("_nf") + F.col("_ns")),
        (known & (f >= rules.BRUTE_FORCE_SUCCESS_THRESHOLD) & (F.col("_s") > 0), "brute_force_success", f),
        (known & (f >= rules.BRUTE_FORCE_THRESHOLD), "brute_force", f),
        (known & (F.col("_blocked") >= rules.PORT_SCAN_THRESHOLD), "port_scan", F.col("_blocked")),
        (F.col(f"{ROW}.is_outbound"), "suspicious_outbound", F.lit(1)),
    ]
    pattern = count = None
    for test, name, n in steps:
        pattern = F.when(test, name) if pattern is None else pattern.when(test, name)
        count = F.when(test, n) if count is None else count.when(test, n)
    seen = F.when(known, F.col("_n")).otherwise(0)
    delta = F.when(known & (gap <= window_s * US),
                   round_to(F.greatest(F.lit(0.1), gap / F.lit(float(US))), 2)).otherwise(300.0)
    return rows.select(
        *[F.col(f"{ROW}.`{c}`").alias(c) for c in events.columns],
        pattern.otherwise("none").alias("correlation_pattern"),
        count.otherwise(seen).cast("bigint").alias("correlation_count"),
        seen.cast("bigint").alias("correlation_events"),
        delta.alias("correlation_delta"),
    )


SCALE = 1_000_000_000


def _plogp(n):
    """n*log2(n) in integer billionths, so that the running sum is exact."""
    return F.when(n > 0, F.round(n * F.log2(n.cast("double")) * F.lit(float(SCALE))).cast("bigint")).otherwise(0)


def port_scan_score(events: DataFrame, keys: Sequence[str] = ("src_ip",), window_s: int = 60) -> DataFrame:
    """Scan score of each event from its address's ports in (t-60 s, t].

    Entropy = log2(n) - sum(c*log2(c))/n over the per-port counts c; each port counter
    reports how its term changes, so the sum runs along.
    """
    keys = list(keys)
    rows = dealt(live_rows(events, [*keys, "dst_port"], "ts_us", window_s * US), *keys)
    sign = F.col(SIGN)
    rows = rows.withColumn("_c", F.sum(sign).over(step_by_step(*keys, "dst_port")))
    after, before = F.col("_c"), F.col("_c") - sign
    w = so_far(*keys)
    rows = rows.withColumns({
        "_n": F.sum(sign).over(w),
        "_u": F.sum((after > 0).cast("bigint") - (before > 0).cast("bigint")).over(w),
        "_g": F.sum(_plogp(after) - _plogp(before)).over(w),
    }).where(EVENT)
    n, u = F.col("_n").cast("double"), F.col("_u").cast("double")
    rate = n / F.lit(window_s / 60.0)
    diversity = u / n
    bits = F.when(F.col("_u") == 1, F.lit(0.0)).otherwise(
        F.log2(n) - F.col("_g").cast("double") / F.lit(float(SCALE)) / n)
    entropy = bits / F.log2(F.lit(65535.0))
    score = diversity * 0.5 + entropy * 0.3 + F.least(rate / 500.0, F.lit(1.0)) * 0.2
    enough = F.col("_n") >= 5
    return rows.select(
        f"{ROW}.*",
        F.when(enough, round_to(score, 4)).otherwise(0.0).alias("nmap_score"),
        (enough & (F.col("_u") > 20) & (diversity > 0.7) & (rate > 50)).alias("is_scan"),
        F.when(enough, F.col("_u")).otherwise(0).cast("bigint").alias("unique_ports"),
        F.when(enough, round_to(rate, 1)).otherwise(0.0).alias("rate_per_min"),
        F.when(enough, round_to(diversity, 3)).otherwise(0.0).alias("diversity_ratio"),
        F.when(enough, round_to(entropy, 3)).otherwise(0.0).alias("port_entropy"),
    )


def lateral_movement_history(events: DataFrame, window_s: int = 300, min_severity: float = 0.6) -> DataFrame:
    """Adds ``lateral_history``: severe event with an earlier SSH success on another asset.

    Same client and address, strictly earlier, within five minutes. Successes on other
    assets = all successes of the address minus those of the event's own asset.
    """
    hit = F.lower("event_type").rlike("ssh.*success").cast("bigint")
    keep = ["client_id", IP, "asset_id", "_hit"]
    rows = live_rows(events.withColumns({"_hit": hit, IP: address_key("src_ip", "ts_us")}), keep, "ts_us", window_s * US, delay_us=1)
    rows = dealt(rows, "client_id", IP)
    change = F.col(SIGN) * F.col("_hit")
    rows = rows.withColumns({
        "_own": F.sum(change).over(so_far("client_id", IP, "asset_id")),
        "_any": F.sum(change).over(so_far("client_id", IP)),
    }).where(EVENT)
    severe = F.coalesce(F.col(f"{ROW}.severity_score"), F.lit(0.0)) >= min_severity
    found = severe & (F.col("_any") > F.col("_own")) & (F.coalesce(F.col(f"{ROW}.src_ip"), F.lit("")) != "")
    return rows.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in events.columns], found.alias("lateral_history"))
