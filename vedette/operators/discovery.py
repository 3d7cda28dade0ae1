"""Column discovery over loosely structured logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.text import google_asset
from ..session import cut_lineage, small_side


def resolve_google_asset(events: DataFrame, batch: Sequence[str], actor: str, parameter: str) -> DataFrame:
    """Adds ``target_asset``. If any actor of the batch is external the whole batch uses the parameter.

    One flag per batch, aggregated before the join back; without batch keys the whole frame is one.
    """
    external = F.bool_or(F.coalesce(F.col(actor).rlike(rules.EXTERNAL_ACTOR), F.lit(False)))
    if not batch:
        found = events.agg(external).scalar()
        return events.withColumn("target_asset", google_asset(actor, parameter, found))
    flags = small_side(events.groupBy(*batch).agg(external.alias("_external")))
    return (events.join(flags, list(batch), "left")
            .withColumn("target_asset", google_asset(actor, parameter, "_external")).drop("_external"))


def profile_paths(flat: DataFrame, fields: str = "fields") -> DataFrame:
    """Per path of a flat-map column: rows, non-null values, mean length, number and IPv4 shares, maximum."""
    v = F.col("value")
    number = v.try_cast("double")
    return flat.select(F.explode(fields).alias("path", "value")).groupBy("path").agg(
        F.count("*").alias("rows"), F.count("value").alias("filled"),
        (F.sum(F.length("value")) / F.nullif(F.count("value"), F.lit(0))).alias("mean_length"),
        (F.count(number) / F.nullif(F.count("value"), F.lit(0))).alias("number_share"),
        (F.count_if(v.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")) / F.nullif(F.count("value"), F.lit(0))).alias("ipv4_share"),
        F.max(number).alias("max_number"))


def _ranked(profile: DataFrame, names: Sequence[str], key) -> DataFrame:
    """Paths whose name is in the list, with their place in it (a literal array of at most 26 names)."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), key)
    return profile.withColumn("_place", place).where("_place > 0")


def discover_asset_column(profile: DataFrame) -> DataFrame:
    """The path that names the asset: best listed name with short values, else a path with addresses."""
    name = F.replace(F.lower("path"), F.lit("-"), F.lit("_"))
    listed = _ranked(profile.where(f"filled > 0 and mean_length <= {rules.MAX_IDENTIFIER_LENGTH}"), rules.ASSET_COLUMNS, name)
    other = profile.where("ipv4_share > 0").withColumn("_place", F.lit(1000))
    return listed.unionByName(other, allowMissingColumns=True).agg(
        F.min_by("path", F.struct("_place", "path")).alias("asset_column"))


def discover_time_column(profile: DataFrame) -> DataFrame:
    """The first path (by name) that hints at a time, and its unit: ms, s or text."""
    hinted = profile.where(F.lower("path").rlike("|".join(rules.TIME_HINTS)))
    unit = F.when((F.col("number_share") == 1.0) & (F.col("max_number") > 4_102_444_800), "ms").when(
        F.col("number_share") == 1.0, "s").otherwise("text")
    return hinted.agg(F.min(F.struct("path", unit.alias("unit"))).alias("x")).select(
        F.col("x.path").alias("time_column"), F.col("x.unit").alias("unit"))


def parsed_time(value, unit: str):
    """Microseconds of the discovered time column; NULL where it cannot be read."""
    number = value.try_cast("double")
    if unit == "ms":
        return (number * 1e3).cast("bigint")
    return (number * 1e6).cast("bigint") if unit == "s" else F.unix_micros(F.try_to_timestamp(value))


def discover_event_column(profile: DataFrame) -> DataFrame:
    listed = _ranked(profile, rules.EVENT_COLUMNS, F.lower("path"))
    return listed.agg(F.min_by("path", F.struct("_place", "path")).alias("event_column"))


LISTED = 1000
LARGEST = 1e300  # keeps the span between two values finite


def feature_id(path) -> Column:
    """60 bits of the md5 of a path."""
    return F.conv(F.substr(F.md5(path), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def _cell(value, as_number) -> Column:
    """Numbers as they are (NaN 0, infinite ones cut), other texts hashed to 0..999."""
    number = F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.nanvl(value.try_cast("double"), F.lit(0.0))))
    code = F.conv(F.substr(F.md5(value), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % 1000
    return F.when(as_number, number).otherwise(code.cast("double"))


def sparse_vector(flat: DataFrame, profile: DataFrame, row_id: str, fields: str = "fields", leave_out: str | None = None,
                  out: str = "vector", listed: int = LISTED) -> DataFrame:
    """Adds ``out``, the cells of all paths as (feature, value) sorted by feature; cells of 0 and nulls are left out.

    A path is a number where all its values are; of other paths every value is hashed. Only
    paths with both kinds need a lookup: up to ``listed`` of them are named in the plan and no
    row moves, more are joined to the cells. The result is the same, for any number of paths.
    """
    mixed = cut_lineage(profile.where("number_share > 0 AND number_share < 1").select("path"))
    names = [r["path"] for r in mixed.limit(listed + 1).collect()]
    entry = lambda path, value, number: F.struct(feature_id(path).alias("feature"), _cell(value, number).alias("value"))
    filled = lambda e: e["value"].isNotNull() & (F.lit(True) if leave_out is None else e["key"] != leave_out)
    is_number = lambda v: v.try_cast("double").isNotNull()
    cells = F.filter(F.map_entries(fields), filled)
    if len(names) <= listed:
        vector = F.transform(cells, lambda e: entry(e["key"], e["value"], is_number(e["value"]) & ~e["key"].isin(names)))
        return flat.withColumn(out, F.array_sort(F.filter(vector, lambda e: e["value"] != 0.0)))
    long = flat.select(F.col(row_id).alias("_row"), F.inline(cells).alias("path", "value"))
    marked = long.join(mixed.withColumn("_mixed", F.lit(True)), "path", "left")
    vectors = marked.select("_row", entry(F.col("path"), F.col("value"), is_number(F.col("value")) & F.col("_mixed").isNull()).alias("e"))
    vectors = vectors.where(F.col("e.value") != 0.0).groupBy("_row").agg(F.array_sort(F.collect_list("e")).alias(out))
    none = F.array().cast(vectors.schema[out].dataType)
    joined = flat.join(vectors, F.col(row_id) == F.col("_row"), "left").drop("_row")
    return joined.withColumn(out, F.coalesce(out, none))


def extract_entities(leaves) -> dict:
    """Attacker and victim address, asset and event text from the text leaves of an event.

    Each leaf scores by its key and the key above; the best score wins, the earlier leaf on
    ties. Without an attacker the first other address in the texts is taken.
    """
    ips = F.transform(leaves, lambda x: F.struct(
        x["pos"].alias("pos"), x["parent"].alias("parent"), x["key"].alias("key"),
        F.regexp_extract(x["value"], rules.IPV4, 0).alias("ip")))
    ips = F.filter(ips, lambda x: x["ip"] != "")

    def role(x):
        return (
            F.when(x["key"].isin(*rules.SOURCE_IP_KEYS), F.struct(F.lit("s").alias("r"), F.lit(1.8).alias("w")))
            .when((x["key"] == "ip") & x["parent"].isin(*rules.AGENT_PARENTS), F.struct(F.lit("v").alias("r"), F.lit(1.8).alias("w")))
            .when(x["key"].isin(*rules.VICTIM_IP_KEYS), F.struct(F.lit("v").alias("r"), F.lit(1.5).alias("w")))
            .when(x["parent"].isin(*rules.AGENT_PARENTS), F.struct(F.lit("v").alias("r"), F.lit(1.0).alias("w")))
            .when(x["parent"].isin(*rules.FORENSIC_PARENTS), F.struct(F.lit("s").alias("r"), F.lit(1.0).alias("w")))
            .otherwise(F.struct(F.lit("s").alias("r"), F.lit(0.5).alias("w"))))

    scored = F.transform(ips, lambda x: F.struct(role(x).alias("role"), (-x["pos"]).alias("o"), x["ip"].alias("ip")))

    def best_ip(r: str):
        mine = F.filter(scored, lambda x: x["role"]["r"] == r)
        return F.array_max(F.transform(mine, lambda x: F.struct(x["role"]["w"].alias("w"), x["o"].alias("o"), x["ip"].alias("ip"))))["ip"]

    def best_text(keep, weight):
        mine = F.filter(leaves, keep)
        return F.array_max(F.transform(mine, lambda x: F.struct(weight(x).alias("w"), (-x["pos"]).alias("o"), x["value"].alias("t"))))["t"]

    victim, source = best_ip("v"), best_ip("s")
    other = F.try_element_at(F.filter(ips, lambda x: x["ip"] != victim), F.lit(1))["ip"]
    asset = best_text(
        lambda x: x["key"].isin(*rules.ASSET_KEYS) & F.length(x["value"]).between(3, 63),
        lambda x: F.when(x["key"].contains("agent") | x["key"].contains("name"), 1.5).otherwise(1.0))
    event = best_text(
        lambda x: x["key"].isin(*rules.EVENT_KEYS) & (F.length(x["value"]) > 5) & x["value"].rlike("|".join(rules.EVENT_MARKERS)),
        lambda x: F.lit(1.5))
    return {
        "src_ip": F.coalesce(source, F.when(victim.isNotNull(), other)), "victim_ip": victim,
        "asset_id": F.coalesce(asset, F.lit("unknown")), "event_type": F.coalesce(event, F.lit("Security Event")),
    }
