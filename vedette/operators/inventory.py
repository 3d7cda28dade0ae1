"""Asset inventory: import, casting, checks and change tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import rules
from ..functions.numeric import as_col


def apply_changes(assets: DataFrame, changes: DataFrame, keys: Sequence[str] = ("client_id", "id")) -> DataFrame:
    """Applies a change table: op U patches the non-null columns, op D removes the row.

    Several changes of one key apply in ``seq`` order: the newest non-null value per column
    wins, and a delete wins if it is last.
    """
    keys = list(keys)
    columns = [c for c in changes.columns if c in assets.columns and c not in keys]
    last = changes.groupBy(*keys).agg(
        F.max_by("op", "seq").alias("_op"),
        *[F.max_by(c, F.when(F.col(c).isNotNull() & (F.col("op") == "U"), F.col("seq"))).alias(f"_new_{c}") for c in columns])
    out = assets.join(last, keys, "left").where(F.coalesce("_op", F.lit("")) != "D")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in assets.columns])


def asset_by_id(assets: DataFrame, asset_id, client_id: str) -> DataFrame:
    return assets.where((F.col("id") == asset_id) & (F.col("client_id") == client_id))


def bulk_load(assets: DataFrame, new: DataFrame, client_id: str, key: Sequence[str] = ("client_id", "hostname")) -> DataFrame:
    """Inventory after an insert that ignores rows whose key exists; equal new rows keep the smallest id."""
    key = list(key)
    stamped = new.withColumn("client_id", F.lit(client_id))
    packed = stamped.groupBy(*key).agg(F.min_by(F.struct(*stamped.columns), "id").alias("_r")).select("_r.*")
    return assets.unionByName(packed.join(assets.select(*key), key, "left_anti"), allowMissingColumns=True)


def plain_name(name: str) -> str:
    """Header in lower case without accents and punctuation."""
    text = unicodedata.normalize("NFD", str(name).lower().strip())
    text = "".join(c for c in text if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9 ]", "", text).strip()


def map_headers(columns: Sequence[str], aliases: Mapping[str, Sequence[str]] = rules.INVENTORY_ALIASES) -> dict[str, str]:
    """field -> column by exact field name, else by the first alias present. Works on names only."""
    present = {plain_name(c): c for c in columns}
    found = {}
    for field, names in aliases.items():
        column = next((present[n] for n in (plain_name(x) for x in (field, *names)) if n in present), None)
        if column is not None:
            found[field] = column
    return found


def map_inventory_columns(df: DataFrame) -> dict[str, str]:
    """Header match, then content checks (address, MAC, money) for what is still missing.

    The content checks are one aggregation to a single row, over all rows.
    """
    mapping = map_headers(df.columns)
    missing = [f for f in ("ip_address", "mac_address", "valor_activo") if f not in mapping]
    if not missing:
        return mapping
    tests = {}
    for i, c in enumerate(df.columns):
        text = F.col(f"`{c}`").cast("string")
        tests |= {
            f"ip_address{i}": F.bool_or(text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")),
            f"mac_address{i}": F.bool_or(text.rlike(r"^([0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}$")),
            f"valor_activo{i}": (F.avg(text.try_cast("double")) > 100) & F.lit("id" not in c.lower()),
        }
    seen = df.agg(*[test.alias(name) for name, test in tests.items()]).first()
    for field in (f for f in rules.INVENTORY_ALIASES if f in missing):
        for i, c in enumerate(df.columns):
            if c not in mapping.values() and seen[f"{field}{i}"]:
                mapping[field] = c
                break
    return {f: mapping[f] for f in rules.INVENTORY_ALIASES if f in mapping}


def cast_field(c: str | Column, kind: str) -> Column:
    """Text to decimal (1.500,00 and $1,500.00), int clamped to 1..5, boolean words, or trimmed text."""
    t = F.trim(as_col(c).cast("string"))
    t = F.when(t != "", t)
    if kind == "decimal":
        european = t.rlike(r"\d{1,3}(\.\d{3})+(,\d+)?$")
        plain = F.when(european, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t)
        digits = F.regexp_replace(plain, r"[^\d.]", "")
        return F.when(t.isNotNull(), F.coalesce(digits.try_cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)")))
    if kind == "int":
        number = F.coalesce(t.try_cast("double"), F.regexp_replace(t, r"\D", "").try_cast("double"), F.lit(0.0))
        return F.when(t.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), number.cast("int"))))
    if kind == "bool":
        return F.lower(t).isin(*rules.TRUE_WORDS)
    return t


def sensitivity_flags(c: str | Column) -> dict[str, Column]:
    text = F.upper(F.coalesce(as_col(c).cast("string"), F.lit("")))
    return {f"contiene_{x.lower()}": text.contains(x) for x in ("PII", "PCI", "PHI", "PFI")}


def cast_inventory(df: DataFrame, mapping: Mapping[str, str], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Typed inventory rows plus ``nombre_activo``-less rejects, told apart by ``rejected``."""
    out = {f: cast_field(F.col(f"`{c}`"), rules.INVENTORY_TYPES.get(f, "str")) for f, c in mapping.items()}
    for f, value in (defaults or {}).items():
        out.setdefault(f, F.lit(value))
    for f in ("valor_confidencialidad", "valor_integridad", "valor_disponibilidad"):
        out[f] = F.coalesce(out.get(f, F.lit(None).cast("int")), F.lit(3))
    label = next((c for c in df.columns if "clasifica" in plain_name(c) or "sensibilidad" in plain_name(c)), None)
    if label is not None:
        for f, test in sensitivity_flags(F.col(f"`{label}`")).items():
            out[f] = F.when(test, F.lit(True)).otherwise(out.get(f, F.lit(None).cast("boolean")))
    name = out.get("nombre_activo", F.lit(None).cast("string"))
    kept = [c for c in ("row_number", "source_file") if c in df.columns]
    return df.select(*kept, *[x.alias(f) for f, x in out.items()], name.isNull().alias("rejected"))


def inventory_rejects(cast: DataFrame) -> DataFrame:
    """(row, reason, data) of the rows without a name, and their file if the table has ``source_file``."""
    place = [c for c in ("source_file", "row_number") if c in cast.columns]
    data = [c for c in cast.columns if c not in ("rejected", *place)]
    return cast.where("rejected").select(
        *place, F.lit("nombre_activo es obligatorio").alias("reason"), F.to_json(F.struct(*data)).alias("data"))


def criticality_ok(c: str | Column) -> Column:
    return as_col(c).isNull() | as_col(c).isin(*rules.CRITICALITY_LEVELS)
