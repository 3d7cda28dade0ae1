"""Text predicates and scores as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from .. import rules
from .numeric import as_col, clamp, round_to


def any_word(c: str | Column, words: Iterable[str]) -> Column:
    """True when the lower-cased text contains one of the words."""
    return F.lower(as_col(c)).rlike("|".join(re.escape(w) for w in words))


def by_tier(text: Column, tiers: Iterable[tuple[float, Iterable[str]]], default: float) -> Column:
    """Value of the first tier with a word in the text."""
    out = None
    for value, words in tiers:
        hit = any_word(text, words)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))


def by_key(key: str | Column, table: Mapping[str, object], default) -> Column:
    """Lookup of a small fixed table."""
    out = None
    for k, value in table.items():
        hit = as_col(key) == k
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))


def by_contained(text: str | Column, table: Mapping[str, object], default) -> Column:
    """Lookup by the first key contained in the text."""
    out = None
    for k, value in table.items():
        hit = as_col(text).contains(k)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))


def _inline(pattern: str) -> str:
    """``(?i)x`` as the group ``(?i:x)`` so that patterns can be alternated."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    return f"(?{flags.group(1)}:{pattern[flags.end():]})" if flags else f"(?:{pattern})"


def sanitize_text(c: str | Column, limit: int | None = None) -> Column:
    """Drop control characters, redact injection attempts; cut for display only if a limit is given.

    One combined test guards the chain of replacements: most texts hold no attempt.
    """
    clean = F.regexp_replace(as_col(c), rules.CONTROL_CHARS, "")
    redacted = clean
    for pattern in rules.INJECTION_PATTERNS:
        redacted = F.regexp_replace(redacted, pattern, rules.REDACTED)
    suspicious = clean.rlike("|".join(_inline(p) for p in rules.INJECTION_PATTERNS))
    safe = F.when(suspicious, redacted).otherwise(clean)
    if limit is None:
        return safe
    return F.when(F.length(safe) > limit, F.concat(F.substring(safe, 1, limit), F.lit("[...]"))).otherwise(safe)


def payload_size_ok(c: str | Column, limit: int = rules.MAX_PAYLOAD_BYTES) -> Column:
    return F.octet_length(as_col(c)) <= limit


def looks_like_json(c: str | Column) -> Column:
    return F.substring(F.ltrim(as_col(c)), 1, 1).isin("{", "[")


def detect_source(raw: str | Column) -> Column:
    """Vendor name from the top-level keys of a JSON object; first signature wins."""
    keys = F.json_object_keys(as_col(raw))
    kind = F.get_json_object(as_col(raw), "$.kind")
    out = None
    for alternatives, name in rules.SOURCE_SIGNATURES:
        hit = None
        for wanted in alternatives:
            both = None
            for k in wanted:
                has = F.array_contains(keys, k)
                both = has if both is None else both & has
            hit = both if hit is None else hit | both
        if name == "google_workspace":
            hit = hit & kind.startswith(rules.KIND_PREFIX)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def _tests(text: Column, regex: str) -> list[Column]:
    """Tests for one regex, each guarded by its longest fixed part.

    A substring scan is cheaper than the regex engine, and nearly every text fails it.
    Only regexes made of literals, ``.`` and ``.*`` are guarded; others run as they are.
    """
    tests = []
    for part in regex.split("|") if "(" not in regex else [regex]:
        match = text.rlike("(?d)" + part)
        if re.fullmatch(r"""(?:[a-z0-9_ /'"<=@-]|\\[./]|\.\*|\.)+""", part):
            fixed = [f.replace("\\", "") for f in re.split(r"(?<!\\)\.\*?", part)]
            found = text.contains(max(fixed, key=len))
            tests.append(found if len(fixed) == 1 else found & match)
        else:
            tests.append(match)
    return tests


def classify_pattern(text: str | Column, severity: str | Column, command: str | Column | None = None,
                     families=rules.PATTERN_FAMILIES) -> Column:
    """struct(pattern, confidence, reason): the surest family that matches, earlier ones first on ties.

    The families are tested from the surest down, so a row stops at its first hit.
    """
    full = as_col(text) if command is None else F.concat_ws(" ", as_col(text), as_col(command))
    full = F.lower(full)

    def hit(regexes) -> Column:
        out = None
        for test in (one for r in regexes for one in _tests(full, r)):
            out = test if out is None else out | test
        return out

    tests = {name: hit(regexes) for name, _, regexes, _ in families}

    def result(name, confidence, reason) -> Column:
        return F.struct(F.lit(name).alias("pattern"), F.lit(float(confidence)).alias("confidence"),
                        F.lit(reason).alias("reason"))

    out = None
    for name, confidence, regexes, reason in sorted(families, key=lambda f: -f[1]):
        test = hit(regexes)
        blocker = rules.SUPPRESSED_BY.get(name)
        if blocker in tests:
            test = test & ~tests[blocker]
        out = F.when(test, result(name, confidence, reason)) if out is None else out.when(
            test, result(name, confidence, reason))
    severe = as_col(severity) >= 0.8
    return out.when(severe, result(*rules.HIGH_SEVERITY_EVENT)).otherwise(result(*rules.NO_PATTERN))


def severity_level(score: str | Column) -> Column:
    s = as_col(score)
    return F.when(s >= 0.85, "critical").when(s >= 0.65, "high").when(s >= 0.40, "medium").otherwise("low")


def command_feature(command: str | Column) -> Column:
    c = as_col(command)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0.0)).otherwise(
        by_tier(c, rules.COMMAND_TIERS, rules.COMMAND_DEFAULT))


def danger_score(event_name: str | Column) -> Column:
    return by_tier(F.coalesce(as_col(event_name), F.lit("None")), rules.DANGER_TIERS, rules.DANGER_DEFAULT)


def is_forced_anomaly(danger: str | Column) -> Column:
    return as_col(danger) >= rules.FORCED_DANGER


def sensor_danger(topic: str | Column, value: str | Column, thresholds=None) -> Column:
    """0.1 in the normal range, 0.3..1.0 above it; unknown sensors use a log scale over 100."""
    topic, v = F.lower(as_col(topic)), as_col(value)
    out = None
    for word, (normal, critical) in (thresholds or rules.SENSOR_THRESHOLDS).items():
        ratio = (v - F.lit(normal)) / F.lit(critical - normal + 1.0)
        score = F.when(v <= normal, F.lit(0.1)).otherwise(
            round_to(F.least(F.lit(1.0), F.lit(0.3) + ratio * F.lit(0.7)), 3))
        hit = topic.contains(word)
        out = F.when(hit, score) if out is None else out.when(hit, score)
    generic = round_to(F.least(F.lit(1.0), F.log10(v / F.lit(100.0) + F.lit(1.0)) * F.lit(0.5)), 3)
    return out.when(v > 100.0, generic).otherwise(F.lit(0.1))


def is_sensor_anomaly(score: str | Column) -> Column:
    return as_col(score) >= rules.FORCED_SENSOR_DANGER


def auth_flags(event_type: str | Column) -> dict[str, Column]:
    """Substring predicates. ``login`` counts as success, so ``login_failure`` is both."""
    e = F.coalesce(as_col(event_type), F.lit(""))
    return {
        "is_failure": any_word(e, rules.FAILURE_WORDS),
        "is_success": any_word(e, rules.SUCCESS_WORDS),
        "is_blocked": any_word(e, rules.BLOCKED_WORDS),
        "is_outbound": any_word(e, rules.OUTBOUND_WORDS),
    }


def event_type_id(event_type: str | Column) -> Column:
    head = F.conv(F.substring(F.md5(as_col(event_type).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(1000)).cast("double") / F.lit(1000.0)


def event_hash(asset_id, src_ip, event_type, timestamp) -> Column:
    """SHA-256 of the sorted-key JSON text of four plain-ASCII string fields."""

    def field(name: str, c) -> Column:
        c = as_col(c)
        quoted = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                          F.lit('"'))
        return F.concat(F.lit(f'"{name}": '), F.coalesce(quoted, F.lit("null")))

    text = F.concat(F.lit("{"), F.concat_ws(", ", field("asset_id", asset_id), field("event_type", event_type),
                                            field("src_ip", src_ip), field("timestamp", timestamp)), F.lit("}"))
    return F.sha2(text.cast("binary"), 256)


def numeric_feature(value: str | Column) -> Column:
    v = as_col(value)
    score = round_to(F.least(F.lit(1.0), F.log10(v + F.lit(1.0)) / F.lit(4.0)), 4)
    return F.when(v.isNull() | (v <= 0), F.lit(0.0)).otherwise(score)


def hour_of_day(ts_us: str | Column) -> Column:
    hour = F.pmod(as_col(ts_us), F.lit(86_400_000_000)) / F.lit(3_600_000_000)
    return round_to(F.sin(F.lit(6.283185307179586) * F.floor(hour) / F.lit(24.0)) / F.lit(2.0) + F.lit(0.5), 4)


def day_of_week(ts_us: str | Column) -> Column:
    """Monday 0.0 .. Sunday 1.0; 1970-01-01 was a Thursday."""
    day = F.floor(as_col(ts_us) / F.lit(86_400_000_000))
    return round_to(F.pmod(day + F.lit(3), F.lit(7)) / F.lit(6.0), 4)


def delta_feature(seconds: str | Column) -> Column:
    """Gap since the previous event on a log scale, 1.0 from one hour on and for the first event."""
    log_hour = F.log10(F.lit(3601.0))
    d = F.when(as_col(seconds) > 0, as_col(seconds)).when(as_col(seconds) <= 0, F.lit(0.0))
    return F.coalesce(round_to(F.least(F.lit(1.0), F.log10(d + F.lit(1.0)) / log_hour), 4), F.lit(1.0))


def rate_feature(per_minute: str | Column) -> Column:
    return round_to(F.least(F.lit(1.0), as_col(per_minute) / F.lit(60.0)), 4)


def asset_value_feature(c, i, a, value, ceiling: float = rules.ASSET_VALUE_CEILING) -> Column:
    cia = (as_col(c) + as_col(i) + as_col(a)) / F.lit(15.0)
    money = F.least(F.coalesce(as_col(value), F.lit(0.0)) / F.lit(ceiling), F.lit(1.0))
    return round_to(cia * F.lit(0.6) + money * F.lit(0.4), 4)


def asset_value_norm(value: str | Column, ceiling: float = rules.ASSET_VALUE_CEILING) -> Column:
    v = as_col(value)
    return F.when(v <= 0, F.lit(0.0)).when(v <= 1.0, round_to(v, 4)).otherwise(
        round_to(F.least(v / F.lit(ceiling), F.lit(1.0)), 4))


def combined_score(river, nmap, src_ip, dst_port) -> Column:
    both = as_col(src_ip).isNotNull() & as_col(dst_port).isNotNull()
    return F.when(both, as_col(river) * F.lit(0.4) + as_col(nmap) * F.lit(0.6)).otherwise(as_col(river))


def density_sigmoid(raw: str | Column) -> Column:
    return round_to(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-8.0) * (as_col(raw) - F.lit(0.3)))), 4)


def effective_pattern(correlation: str | Column, hint: str | Column) -> Column:
    """The correlated pattern unless it is ``none``, else the text hint, else ``none``."""
    return F.coalesce(F.nullif(as_col(correlation), F.lit("none")), as_col(hint), F.lit("none"))


def external_ip(ip: str | Column) -> Column:
    inside = None
    for prefix in rules.INTERNAL_PREFIXES:
        test = as_col(ip).startswith(prefix)
        inside = test if inside is None else inside | test
    return ~inside


def ip_number(ip: str | Column) -> Column:
    """IPv4 text as a number; NULL when it is not an IPv4 address."""
    c = as_col(ip)
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    parts = F.split(c, r"\.")
    number = sum((parts[i].cast("bigint") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(c.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), number)


def is_private_ip(ip: str | Column) -> Column:
    """In a private range; text that is no address counts as private."""
    n = ip_number(ip)
    inside = F.lit(False)
    for base, bits in rules.PRIVATE_CIDRS:
        a, b, c, d = (int(x) for x in base.split("."))
        first = ((a * 256 + b) * 256 + c) * 256 + d
        inside = inside | n.between(first, first + 2 ** (32 - bits) - 1)
    return F.coalesce(inside, F.lit(True))


def normalize_timestamp(text: str | Column) -> Column:
    """Microseconds from compact, epoch (s, ms, us, ns by digit count) or ISO text; NULL when unreadable."""
    t = F.trim(as_col(text).cast("string"))
    compact = F.unix_micros(F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")))
    whole = F.substring_index(t, ".", 1)
    number = whole.try_cast("decimal(30,0)")
    digits = F.length(F.regexp_replace(whole, "^-?0*", ""))
    epoch_s = (
        F.when(digits >= 18, F.floor(number / F.lit(1_000_000_000)))
        .when(digits >= 15, F.floor(number / F.lit(1_000_000)))
        .when(digits >= 12, F.floor(number / F.lit(1000)))
        .otherwise(number)
    ).try_cast("bigint")
    iso = F.unix_micros(F.try_to_timestamp(t))
    return (
        F.when(t.rlike(r"^\d{14}$"), compact)
        .when(t.rlike(r"^-?\d+(\.\d*)?$"), epoch_s * F.lit(1_000_000))
        .otherwise(iso)
    )


def google_asset(actor: str | Column, parameter: str | Column, any_external: str | Column) -> Column:
    """When any actor of the batch is external the affected parameter names the asset."""
    return F.when(as_col(any_external), F.coalesce(as_col(parameter), as_col(actor))).otherwise(as_col(actor))
