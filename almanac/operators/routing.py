"""Notification routing: requester extraction from free-form payloads, destination
lookup, outgoing message fields, and intent extraction from noisy model text.

Payloads are parsed once into a VARIANT; every candidate is a variant path read, so
the whole cascade is one JVM-side projection per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions.text import slug

# Where a requester can be found, in order of preference.
REQUESTER_KEYS = ["requester", "requester_username", "requester_name", "requested_by",
                  "requested_by_username", "request_username", "username", "user"]
REQUESTER_PATHS = ["request.requestedBy.username", "request.requestedBy.displayName", "request.requestedBy.email",
                   "requestedBy.username", "requestedBy.displayName", "notification.request.requestedBy.username"]
OBJECT_NAME_KEYS = ["username", "displayName", "display_name", "name", "email"]
TEXT_FIELDS = ["message", "subject", "body"]
REQUESTER_TEXT_PATTERNS = [r"(?i)(?:requested by|solicitado por|pedido por)\s+@?([a-zA-Z0-9._-]+)",
                           r"(?i)(?:user|usuario)\s*[:=]\s*@?([a-zA-Z0-9._-]+)"]
# Outgoing message defaults.
APP_NAME = "Jellyseerr"
BODY_FIELDS = ["subject", "message", "event", "media_type", "media_tmdbid", "media_tvdbid"]
DEFAULT_BODY = "Evento recebido do Jellyseerr."
DEFAULT_TYPE, DEFAULT_FORMAT, DEFAULT_TAG = "info", "text", "media"
# The closed list of assistant actions.
ACTIONS = ["jellyfin_status", "jellyfin_open", "jellyfin_start", "jellyfin_stop", "ip_local", "disk_usage",
           "media_folders", "arr_status", "arr_list_movies", "arr_list_series", "arr_search_movie",
           "arr_search_series", "arr_download_movie", "arr_download_series", "help", "none"]


WHITESPACE = " \t\n\r\x0b\x0c"


def strip(s: Column) -> Column:
    """``str.strip()`` for ASCII whitespace (a character-set trim, no regex)."""
    return F.trim(s, F.lit(WHITESPACE))


# The requester and message cascades expand to thousands of expression nodes; they are
# written as SQL text and parsed once by the JVM (building them call by call from
# Python costs seconds of round trips per query).
_WS_SQL = " \\t\\n\\r\\u000B\\u000C"


def _sql_literal(text: str) -> str:
    """Body of a SQL string literal (backslashes and quotes escaped)."""
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _sql_path(v: str, path: str) -> str:
    return f"try_variant_get({v}, '$.{path}', 'variant')"


def _sql_clean(t: str) -> str:
    """Trimmed text; blank or an unresolved ``{{...}}`` placeholder -> NULL."""
    tt = f"trim(BOTH '{_WS_SQL}' FROM {t})"
    return (f"CASE WHEN {tt} <> '' AND NOT (startswith({tt}, '{{{{') AND endswith({tt}, '}}}}') AND length({tt}) > 4) "
            f"THEN {tt} END")


def _sql_vstring(x: str) -> str:
    """The variant as cleaned text when it holds a string, else NULL."""
    return f"CASE WHEN schema_of_variant({x}) = 'STRING' THEN {_sql_clean(f'try_variant_get({x}, {chr(39)}${chr(39)}, {chr(39)}string{chr(39)})')} END"


def _sql_expand(e: str) -> str:
    """One level down: a string stays, an object gives its name fields, a list its elements."""
    t = f"schema_of_variant({e})"
    fields = ", ".join(_sql_path(e, k) for k in OBJECT_NAME_KEYS)
    return (f"CASE WHEN {t} = 'STRING' THEN array({e}) WHEN startswith({t}, 'OBJECT') THEN array({fields}) "
            f"WHEN startswith({t}, 'ARRAY') THEN try_variant_get({e}, '$', 'array<variant>') "
            f"ELSE filter(array({e}), z -> false) END")


def _sql_candidate(val: str, typ: str) -> str:
    """The first usable text of a string, of an object's name fields or of a list's elements, at any
    depth and in their order. The value is expanded level by level as often as its own type is
    nested; a list of mixed types hides that, its opening brackets bound it."""
    brackets = f"length(regexp_replace(to_json({val}), '[^\\\\[{{]', ''))"
    levels = f"CASE WHEN contains({typ}, 'VARIANT') THEN {brackets} ELSE length({typ}) - length(replace({typ}, '<', '')) END"
    leaves = f"aggregate(sequence(1, greatest(1, {levels})), array({val}), (acc, i) -> flatten(transform(acc, e -> {_sql_expand('e')})))"
    found = f"get(filter(transform({leaves}, y -> {_sql_vstring('y')}), t -> t IS NOT NULL), 0)"
    return (f"CASE WHEN {typ} = 'STRING' THEN {_sql_vstring(val)} "
            f"WHEN startswith({typ}, 'OBJECT') OR startswith({typ}, 'ARRAY') THEN {found} END")


def with_requester(df: DataFrame, v: str = "_v", out: str = "requester") -> DataFrame:
    """Add the requester found in the parsed payload column ``v``: flat keys, then
    nested paths, then the text patterns over message fields.

    One expression judges every place in turn and stops at the first that names somebody.
    """
    places = ", ".join(_sql_path(v, p) for p in REQUESTER_KEYS + REQUESTER_PATHS)
    named = f"aggregate(array({places}), cast(NULL AS string), (got, c) -> coalesce(got, {_sql_candidate('c', 'schema_of_variant(c)')}))"
    x = df.selectExpr("*", *[f"{_sql_vstring(_sql_path(v, f))} AS _x_{f}" for f in TEXT_FIELDS])
    texts = [f"nullif(regexp_extract(_x_{f}, '{_sql_literal(pat)}', 1), '')" for f in TEXT_FIELDS for pat in REQUESTER_TEXT_PATTERNS]
    x = x.withColumn(out, F.expr("coalesce(" + ", ".join([named] + texts) + ")"))
    return x.drop(*[f"_x_{f}" for f in TEXT_FIELDS])


def normalize_username(x: Column) -> Column:
    """strip, lower, drop leading '@'."""
    return F.ltrim(F.lower(strip(x)), F.lit("@"))


def destination_list(raw: Column) -> Column:
    """Comma-separated destinations -> trimmed non-empty list."""
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")


def route_events(events: DataFrame, routes: DataFrame, default_urls: list[str], payload_col: str = "payload",
                 route_order: str | None = None) -> DataFrame:
    """Requester -> its destinations (direct), else the default list (fallback),
    else none. ``routes`` is (user, urls) with urls a list or a comma-separated text;
    users are normalised and blank destinations dropped here. Of several routes of a
    user the one with the largest ``route_order`` counts (their place in the route file);
    without that column the largest list of destinations. The
    join is an equi left join that AQE broadcasts when the route table is small."""
    urls_t = routes.schema["urls"].dataType
    urls = destination_list(F.col("urls")) if isinstance(urls_t, T.StringType) else F.filter(
        F.transform(F.col("urls"), lambda u: F.trim(u)), lambda u: u != "")
    order = F.col(route_order) if route_order else urls
    r = routes.select(normalize_username(F.col("user")).alias("_user"), urls.alias("_urls"), order.alias("_order")).filter(
        (F.col("_user") != "") & (F.size("_urls") > 0)).groupBy("_user").agg(F.max_by("_urls", "_order").alias("_urls"))
    e = events.withColumn("_v", F.try_parse_json(F.col(payload_col)))
    e = with_requester(e, "_v", "requester")
    e = e.withColumn("_user", normalize_username(F.col("requester")))
    j = e.join(r, "_user", "left")
    defaults = F.array(*[F.lit(u) for u in default_urls]) if default_urls else F.array().cast("array<string>")
    direct = F.col("_urls").isNotNull()
    fallback = ~direct & F.lit(bool(default_urls))
    urls = F.when(direct, F.col("_urls")).when(fallback, defaults).otherwise(F.array().cast("array<string>"))
    return j.withColumn("urls", urls).withColumn("direct", direct).withColumn("fallback", fallback).drop("_user", "_urls")


MESSAGE_KEYS = ["title", "notification_type", "event", "body", "type", "format", "tag"] + BODY_FIELDS


def with_message_fields(df: DataFrame, v: str = "_v", requester: str = "requester") -> DataFrame:
    """Outgoing title, body, type, format and tag with their fallbacks.

    The payload fields are first read once each as cleaned text columns (one
    projection), then combined -- so no field is re-read inside a CASE branch."""
    keys = list(dict.fromkeys(MESSAGE_KEYS))
    x = df.selectExpr("*", *[f"{_sql_vstring(_sql_path(v, k))} AS _m_{k}" for k in keys])

    def fld(k):
        return F.col(f"_m_{k}")

    event_name = F.coalesce(fld("notification_type"), fld("event"))
    title = F.coalesce(fld("title"), F.concat(F.lit(APP_NAME + " | "), event_name), F.lit(APP_NAME))
    parts = F.concat_ws(" | ", *[F.concat(F.lit(k + ": "), fld(k)) for k in BODY_FIELDS])
    body = F.coalesce(fld("body"), F.nullif(parts, F.lit("")), F.lit(DEFAULT_BODY))
    req = F.col(requester)
    tags = F.array_distinct(F.array_compact(F.array(
        F.coalesce(fld("tag"), F.lit(DEFAULT_TAG)), F.when(req.isNotNull(), F.concat(F.lit("requester-"), slug(req))))))
    out = {"title": title, "body": body, "type": F.coalesce(fld("type"), F.lit(DEFAULT_TYPE)),
           "format": F.coalesce(fld("format"), F.lit(DEFAULT_FORMAT)), "tag": F.array_join(tags, ",")}
    x = x.select("*", *[c.alias(k) for k, c in out.items()])
    return x.drop(*[f"_m_{k}" for k in keys])


def outgoing_messages(events: DataFrame, routes: DataFrame, default_urls: list[str], payload_col: str = "payload") -> DataFrame:
    """J6 + P24: routed events with their outgoing message."""
    r = with_message_fields(route_events(events, routes, default_urls, payload_col), "_v", "requester")
    return r.drop(payload_col, "_v")


def extract_intent(text: Column) -> dict[str, Column]:
    """P25: the JSON object inside noisy text (first '{' to last '}') -> action, query,
    id. Invalid or absent JSON -> action 'none'; an action outside the closed list is
    kept as 'none' as well. (Spark's parser accepts a valid object followed by extra
    text inside the braces span, which Python's ``json.loads`` rejects.)"""
    obj = F.regexp_substr(text, F.lit(r"\{[\s\S]*\}"))
    v = F.try_parse_json(obj)
    parsed = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    raw_action = F.try_variant_get(v, "$.action", "string")
    action = F.coalesce(F.nullif(raw_action, F.lit("")), F.lit("none"))
    action = F.when(parsed & action.isin(*ACTIONS), action).otherwise(F.lit("none"))
    q = F.coalesce(F.try_variant_get(v, "$.query", "string"), F.lit(""))
    i = F.coalesce(F.try_variant_get(v, "$.id", "string"), F.lit(""))
    return {"action": action, "query": F.when(parsed, q).otherwise(F.lit("")), "id": F.when(parsed, i).otherwise(F.lit(""))}
