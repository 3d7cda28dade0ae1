"""Secrets in texts: base patterns, and weak candidates that count only in company.

Base spans stand on their own. Weak candidates (an access identifier of another issuer, a
bare 40-character key, a service address) are too common alone; the scopes of a text
(blocks between blank lines) are interval-joined with the parts in them, and a weak
candidate is reported only where a complementary part lies in the same scope (within reach, if one is given):
an identifier with a secret, a key with an identifier or an address, an address with a
secret. Texts with nothing found take no part in any of this.

Positions come from built-in functions only: the pieces between the matches of a pattern
and the matches themselves give lengths, and a running sum over them gives starts. The
interval join is a sweep: scope starts and parts sorted by position, each part belongs to
the last scope that began, and the nearest complementary parts before and after it are
running maxima and minima. That is linear where pairs of parts would be quadratic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import free_name, hex_digest, whole_text

#: Base patterns, the group whose length counts, and its least length.
BASE = {
    "assign": (r"""(?:(?i)(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Weak candidates.
WEAK = {
    "id": (r"\b(?:ASIA|AROA|AIDA|AGPA|ANPA|GOOG)[A-Z0-9]{12,}", 0, 16),
    "key": (r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40),
    "endpoint": (r"""\b(?:https?|ftp|s3|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]+""", 0, 1),
}
SCOPE = (r"\n[ \t\r]*\n", 0, 1)
ORDER = {k: i for i, k in enumerate([*BASE, *WEAK])}


def _found(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """(kind, place, gap before the match, its length, whether it counts) of each match."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else match
    between = F.split(text, pattern)
    return F.when(F.regexp_like(text, F.lit(pattern)), F.transform(match, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(between, i)).alias("gap"),
        F.length(m).alias("size"), (F.length(F.get(part, i)) >= least).alias("ok"))))


def secret_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text", reach: int | None = 400) -> DataFrame:
    """Per distinct (doc, text): ``spans``, an array of (start, order, end, kind) by start then kind.

    Starts and ends are code points, the end exclusive. Base matches are found leftmost and
    without overlap per kind; a match that is too short is dropped but its characters stay
    used. Without a ``reach`` the scope alone decides. Only rows with a span are returned, keyed by ``doc`` and ``text_sha``; repeated
    rows give one. Null texts count as empty. Work per text is linear in its matches.
    """
    body = whole_text(text)
    kinds = [*BASE.items(), *WEAK.items()]
    lists = [F.coalesce(_found(F.col("body"), ORDER[k], *p), F.array()) for k, p in kinds]
    lists.append(F.when(F.regexp_like(F.col("body"), F.lit("|".join(f"(?:{p[0]})" for p in WEAK.values()))),
                        F.coalesce(_found(F.col("body"), -1, *SCOPE), F.array())).otherwise(F.array()))
    rows = (docs.select(F.col(doc).alias("doc"), body.alias("body"))
            .select("doc", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha"), F.concat(*lists).alias("all"))
            .where(F.size("all") > 0)
            .groupBy("doc", "text_sha").agg(F.any_value("all").alias("all"))  # repeated rows once
            .select("doc", "text_sha", F.inline("all")))
    running = Window.partitionBy("doc", "text_sha", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = (rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(running))
              .withColumn("start", F.col("end") - F.col("size")).where("ok"))
    # scopes joined with what lies in them: the last scope mark before a part
    sweep = Window.partitionBy("doc", "text_sha").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, 0)
    scoped = placed.withColumn("scope", F.count(F.when(F.col("kind") < 0, 1)).over(sweep)).where("kind >= 0")
    by_scope = Window.partitionBy("doc", "text_sha", "scope").orderBy("start", "kind", "end")
    before = by_scope.rowsBetween(Window.unboundedPreceding, -1)
    after = by_scope.rowsBetween(1, Window.unboundedFollowing)

    def near(*names: str) -> Column:
        mine = F.col("kind").isin([ORDER[n] for n in names])
        last = F.max(F.when(mine, F.col("end"))).over(before)
        following = F.min(F.when(mine, F.col("start"))).over(after)
        if reach is None:
            return last.isNotNull() | following.isNotNull()
        return (F.coalesce(F.col("start") - last <= reach, F.lit(False))
                | F.coalesce(following - F.col("end") <= reach, F.lit(False)))

    secret = near("assign", "hex", "key")
    kept = (scoped.withColumn("has_secret", secret).withColumn("has_id", near("access", "id"))
            .withColumn("has_endpoint", near("endpoint"))
            .where((F.col("kind") < len(BASE))
                   | (F.col("kind") == ORDER["id"]) & F.col("has_secret")
                   | (F.col("kind") == ORDER["key"]) & (F.col("has_id") | F.col("has_endpoint"))
                   | (F.col("kind") == ORDER["endpoint"]) & F.col("has_secret")))
    name = F.element_at(F.array(*[F.lit(k) for k in ORDER]), F.col("kind") + 1)
    return (kept.groupBy("doc", "text_sha")
            .agg(F.array_sort(F.collect_list(F.struct("start", F.col("kind").alias("order"), "end", name.alias("kind"))))
                 .alias("spans"))
            .withColumnRenamed("doc", doc))


def scan_secrets(docs: DataFrame, doc: str = "doc_id", text: str = "text", reach: int | None = 400) -> DataFrame:
    """Adds ``spans`` to every row, an empty array where nothing was found.

    Rows keep their order of columns; an existing ``spans`` is replaced; repeated rows and
    null ids get their spans as well.
    """
    d, sha = free_name(docs, "_doc"), free_name(docs, "_sha")
    found = secret_spans(docs, doc, text, reach).select(F.col(doc).alias(d), F.col("text_sha").alias(sha),
                                                        F.col("spans").alias(f"{d}_spans"))
    rows = docs.drop("spans").withColumn(sha, hex_digest(whole_text(text)))
    joined = rows.join(found, F.col(doc).eqNullSafe(F.col(d)) & (rows[sha] == found[sha]), "left")
    empty = F.array().cast(found.schema[f"{d}_spans"].dataType)
    return joined.select(*[rows[c] for c in rows.columns if c != sha], F.coalesce(f"{d}_spans", empty).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(df: DataFrame) -> DataFrame:
    """Counts and the digest of the base spans, and all spans as text, from ``spans``."""
    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return df.select(*[c for c in df.columns if c != "spans"], *[of(k) for k in BASE],
                     hex_digest(written(base)).alias("base_sha256"), written(F.col("spans")).alias("spans"))
