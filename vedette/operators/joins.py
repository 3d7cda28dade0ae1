"""Enrichment joins against the inventory and threat intelligence.

No broadcast hint anywhere: inventories grow with the number of tenants, so the planner
decides from measured sizes (broadcast when small, else a shuffle join whose hot keys
are split by AQE).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import rules
from ..functions.numeric import HOUR_US, US, div_us
from ..functions.text import is_private_ip

DAY_US = 86_400 * US
ASSET_FIELDS = ("id", "hostname", "nombre_activo", "tipo_activo", "ip_address", "valor_activo", "clasificacion_criticidad",
                "valor_confidencialidad", "valor_integridad", "valor_disponibilidad", "contiene_pii", "contiene_pci",
                "contiene_phi", "contiene_pfi")


def _one_per(assets: DataFrame, key: Column, fields: Sequence[str]) -> DataFrame:
    """One asset (smallest id) per (client, key)."""
    packed = F.struct(*fields)
    return (assets.where(key.isNotNull()).groupBy("client_id", key.alias("_key"))
            .agg(F.min_by(packed, "id").alias("_asset")))


def match_asset(events: DataFrame, assets: DataFrame, technical_id: str | None = None, hostname: str | None = None,
                ip_address: str | None = None, out: str = "asset") -> DataFrame:
    """Adds the matching asset as a struct, NULL when none is registered.

    Priority: technical id, host name, asset name (any case), address. One equi join per
    identifier instead of a join on an OR, which could only run as a nested loop.
    """
    fields = [c for c in ASSET_FIELDS if c in assets.columns]
    ways = []
    if technical_id:
        ways.append((F.col(technical_id), F.col("technical_id")))
    if hostname:
        ways.append((F.col(hostname), F.col("hostname")))
        ways.append((F.lower(hostname), F.lower("nombre_activo")))
    if ip_address:
        ways.append((F.col(ip_address), F.col("ip_address")))
    found = []
    for i, (event_key, asset_key) in enumerate(ways):
        dim = _one_per(assets, asset_key, fields).withColumnsRenamed({"_asset": f"_asset{i}", "_key": f"_key{i}"})
        events = events.withColumn(f"_key{i}", event_key).join(dim, ["client_id", f"_key{i}"], "left").drop(f"_key{i}")
        found.append(f"_asset{i}")
    if not found:
        raise ValueError("name at least one identifier column")
    return events.withColumn(out, F.coalesce(*found)).drop(*found)


def fetch_asset_meta(events: DataFrame, assets: DataFrame, key: str = "asset_id", out: str = "asset_meta") -> DataFrame:
    """Adds the host's risk attributes with defaults (CIA 3, flags false); NULL if unregistered."""
    def flag(c: str) -> Column:
        return F.coalesce(c, F.lit(False)).alias(c)

    def level(c: str) -> Column:
        return F.coalesce(c, F.lit(3)).alias(c)

    meta = F.struct(
        F.coalesce("valor_activo", F.lit(0.0)).alias("valor_activo"), F.col("clasificacion_criticidad"),
        level("valor_confidencialidad"), level("valor_integridad"), level("valor_disponibilidad"),
        flag("contiene_pii"), flag("contiene_pci"), flag("contiene_phi"), flag("contiene_pfi"))
    dim = (assets.where(F.col("hostname").isNotNull()).groupBy("client_id", F.col("hostname").alias(key))
           .agg(F.min_by(meta, "id").alias(out)))
    return events.join(dim, ["client_id", key], "left")


def train_asset_join(features: DataFrame, assets: DataFrame) -> DataFrame:
    """Adds ``valor_activo`` of the registered host, NULL otherwise."""
    dim = (assets.where(F.col("hostname").isNotNull()).groupBy("client_id", F.col("hostname").alias("asset_id"))
           .agg(F.min_by(F.struct("valor_activo"), "id").alias("_a"))
           .select("client_id", "asset_id", "_a.valor_activo"))
    return features.join(dim, ["client_id", "asset_id"], "left")


FOREVER = 2**62
LONG_US = 2 * DAY_US


def _blocked_times(intel: DataFrame) -> DataFrame:
    """Per address, the disjoint times in which some blocklist entry holds."""
    order = Window.partitionBy("ip").orderBy("valid_from_us", "_until")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = intel.where("source = 'local_blocklist'")
    starts = F.coalesce(F.col("valid_from_us") > F.max("_until").over(so_far), F.lit(True)).cast("int")
    rows = rows.withColumn("_start", starts).withColumn("_island", F.sum("_start").over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy("ip", "_island").agg(F.min("valid_from_us").alias("f"), F.max("_until").alias("u"))
    return islands.groupBy(F.col("ip").alias("_bip")).agg(F.collect_list(F.struct("f", "u")).alias("_blocked"))


def threat_intel_enrich(events: DataFrame, intel: DataFrame, ts: str = "ts_us") -> DataFrame:
    """Adds ``threat_intel`` and ``ti_details`` for public addresses.

    An entry holds from ``valid_from_us`` until ``valid_to_us`` (NULL: for good). While a
    blocklist entry of the address holds, it decides: malicious with confidence 90. Else the
    newest feed entry so far counts if it still holds (of one instant the higher
    confidence), malicious from a score of 25. Equi joins only, so streams can use it: feed
    entries of up to two days meet events per (address, hour), longer ones and the
    blocklist, of which an address has few once disjoint, come as one list per address.
    """
    intel = intel.withColumn("_until", F.coalesce("valid_to_us", F.lit(FOREVER)))
    w = Window.partitionBy("ip").orderBy("valid_from_us")
    feed = (
        intel.where("source != 'local_blocklist'").groupBy("ip", "valid_from_us")
        .agg(F.max(F.struct("confidence", "source", "_until")).alias("_x")).select("ip", "valid_from_us", "_x.*")
        .withColumn("_until", F.least("_until", F.coalesce(F.lead("valid_from_us").over(w), F.lit(FOREVER))))
        .where("_until > valid_from_us")
        .select("ip", F.col("valid_from_us").alias("f"), F.col("_until").alias("u"), F.struct(
            (F.col("confidence") >= rules.INTEL_MALICIOUS_SCORE).alias("malicious"), "source", "confidence").alias("d"))
    )
    is_long = F.col("u") - F.col("f") > LONG_US
    long = feed.where(is_long).groupBy(F.col("ip").alias("_lip")).agg(F.collect_list(F.struct("f", "u", "d")).alias("_long"))
    short = feed.where(~is_long).select(F.col("ip").alias("_ip"), F.col("f").alias("_from"), F.col("u").alias("_until"),
                                        F.col("d").alias("_short"), F.explode(F.sequence(
                                            div_us("f", HOUR_US), div_us(F.col("u") - 1, HOUR_US))).alias("_hour"))
    t = F.col(ts)
    key = F.when(~is_private_ip("src_ip"), F.col("src_ip"))
    blocked = _blocked_times(intel)
    joined = (
        events.withColumns({"_pub": key, "_at_hour": div_us(t, HOUR_US)})
        .join(blocked, F.col("_pub") == F.col("_bip"), "left")
        .join(long, F.col("_pub") == F.col("_lip"), "left")
        .join(short, (F.col("_pub") == F.col("_ip")) & (F.col("_at_hour") == F.col("_hour"))
              & (t >= F.col("_from")) & (t < F.col("_until")), "left")
    )
    on_list = F.exists("_blocked", lambda x: (x["f"] <= t) & (t < x["u"]))
    lasting = F.get(F.filter("_long", lambda x: (x["f"] <= t) & (t < x["u"])), F.lit(0))["d"]
    verdict = F.struct(F.lit(True).alias("malicious"), F.lit("local_blocklist").alias("source"),
                       F.lit(rules.BLOCKLIST_CONFIDENCE).cast("int").alias("confidence"))
    details = F.when(on_list, verdict).otherwise(F.coalesce("_short", lasting))
    return (joined.withColumn("ti_details", details)
            .withColumn("threat_intel", F.coalesce("ti_details.malicious", F.lit(False)))
            .drop("_pub", "_at_hour", "_hour", "_ip", "_from", "_until", "_short", "_long", "_lip", "_blocked", "_bip"))


def drop_known(events: DataFrame, known: DataFrame | None = None, key: str = "raw_hash", tenant: str = "client_id") -> DataFrame:
    """One event per tenant and hash, none whose hash the tenant has stored; the earliest stays.

    Events without a hash cannot be repeats and all stay. The narrow pass finds the surviving
    ids, so wide rows are not sorted or shuffled by hash when the join side is small.
    """
    first = (events.where(F.col(key).isNotNull()).groupBy(tenant, key)
             .agg(F.min(F.struct("ts_us", "event_id")).alias("_first")))
    if known is not None:
        first = first.join(known.select(tenant, key), [tenant, key], "left_anti")
    fresh = first.select(F.col("_first.event_id").alias("event_id")).union(
        events.where(F.col(key).isNull()).select("event_id"))
    return events.join(fresh, "event_id", "left_semi")


def last_feature_vector(incidents: DataFrame, features: DataFrame, vector: str = "features_vector",
                        chunk_us: int = DAY_US) -> DataFrame:
    """Adds the asset's newest feature vector at or before ``created_us`` (as-of).

    Both sides are laid on one time line per (client, asset), cut into days; see chunked.
    """
    from .chunked import last_known

    left = incidents.select("client_id", "asset_id", F.col("created_us").alias("_t"), F.lit(1).alias("_side"),
                            F.col("id").alias("_tie"),
                            F.struct(*[F.col(c) for c in incidents.columns]).alias("_rec"))
    right = features.select("client_id", "asset_id", F.col("ts_us").alias("_t"), F.lit(0).alias("_side"),
                            F.col("event_id").alias("_tie"), F.col(vector).alias("_v"))
    line = left.unionByName(right, allowMissingColumns=True)
    known = last_known(line, ["client_id", "asset_id"], ["_t", "_side", "_tie"], div_us("_t", chunk_us), "_v", vector)
    return known.where("_side = 1").select("_rec.*", vector)
