"""Scalar functions as columns: paths, urls, identity, latency buckets, severity."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JSON types, and levels of severity from the worst.
TYPES = ["string", "integer", "number", "boolean", "null", "object", "array"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "DORMANT", "NONE_OBSERVED", "UNRATED"]


def normalise_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\{[^/}]*\}", "{}")


def template_names(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(r"\{([^/}]*)\}"), F.lit(1))


def media_key(media: Column) -> Column:
    return F.trim(F.lower(F.split_part(media, F.lit(";"), F.lit(1))))


def is_json_media(media: Column) -> Column:
    m = media_key(media)
    return m.isin("application/json", "*/*", "application/*") | m.endswith("+json")


def child_path(parent: Column, name: Column) -> Column:
    quoted = F.concat(parent, F.lit("['"), F.regexp_replace(name, r"(['\\])", r"\\$1"), F.lit("']"))
    return F.when(name.rlike("^[A-Za-z0-9_-]+$"), F.concat(parent, F.lit("."), name)).otherwise(quoted)


def path_tokens(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(r"(\.[^.\[]+|\[\]|\['(?:\\.|[^'\\])*'\])"), F.lit(1))


def parent_path(path: Column) -> Column:
    tokens = path_tokens(path)
    return F.when(F.size(tokens) > 0, F.concat(F.lit("$"), F.array_join(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), "")))


def leaf(path: Column) -> Column:
    return F.regexp_replace(F.element_at(path_tokens(path), -1), r"^\.|^\['|'\]$", "")


def url_target(url: Column) -> Column:
    """Path and query of an absolute or relative url."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def url_path(url: Column) -> Column:
    return F.split_part(url_target(url), F.lit("?"), F.lit(1))


def query_pairs(url: Column) -> Column:
    """Array of (name, value); what cannot be decoded stays as it is."""
    target = url_target(url)
    text = F.when(F.instr(target, "?") > 0, F.substring_index(F.regexp_replace(target, r"^[^?]*\?", "q?"), "q?", -1)).otherwise("")
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.filter(F.split(text, "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(decode(F.split_part(p, F.lit("="), F.lit(1))).alias("name"), decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("value")))


#: Segments that look like values and not like names.
VALUE_LIKE = [r"^[0-9]+$", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^(?=.*[0-9])[0-9a-fA-F]{8,}$", r"^.{20,}$", r"@", r"%"]


def redact_path(path: Column) -> Column:
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda s: F.when(s.rlike("|".join(VALUE_LIKE)), "{*}").otherwise(s)), "/"))


def pseudonym(salt: str, value: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 16)


def latency_bucket(ms: Column) -> Column:
    return F.when(ms <= 1, 0).otherwise(F.ceil(F.ln(ms) / F.ln(F.lit(1.25)) - 1e-9)).cast("int")


def latency_edge(bucket: Column) -> Column:
    return round_half_up(F.pow(F.lit(1.25), bucket), 1)


def round_half_up(x: Column, places: int) -> Column:
    return F.floor(x * 10**places + 0.5) / 10**places


def unseen_bound(n: Column) -> Column:
    """Largest rate that n looks can have missed, at 95 %."""
    return F.when(n > 0, 1 - F.pow(F.lit(0.05), 1.0 / n))


def capitalise(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def map_value_path(parent: Column) -> Column:
    """The path of a map's values."""
    return F.concat(parent, F.lit(".*"))


def window_days(first: Column, last: Column) -> Column:
    """Days of a window, a second at least; 0 without events."""
    return F.when(first.isNull() | last.isNull(), 0.0).otherwise(F.greatest((F.unix_millis(last) - F.unix_millis(first)) / 86_400_000, F.lit(1 / 86_400)))


def detectable_rate(days: Column) -> Column:
    """Least calls a day that a window of so many days shows, at 95 %."""
    return F.when(days > 0, 3 / days).otherwise(0.0)


def tier(n: Column) -> Column:
    return F.when(n >= 100, "high").otherwise("low")


def severity(affected: Column, recent: Column, stale: Column, active: Column, critical: Column, config) -> Column:
    share = F.when(active > 0, recent / active).otherwise(0.0)
    return (
        F.when(affected == 0, "NONE_OBSERVED")
        .when((recent > 0) & (share >= config.critical_share), "CRITICAL")
        .when(critical | (recent >= config.high_clients) | ((recent > 0) & (share >= config.high_share)), "HIGH")
        .when(recent >= 1, "MEDIUM")
        .when(stale >= 1, "LOW")
        .otherwise("DORMANT")
    )
