"""Cleaning, extraction, pseudonyms and the canonical event: parsed field maps to typed columns, in Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CONTROL, IPV4, all_of, any_of, canonical_ip, contains_any, empty_to_null, hmac_of, hmac_sha256, lookup, to_int, valid_ip, valid_ipv4, valid_port
from ..functions.store import settled
from ..functions.times import common_sql, let, parse_timestamp, timestamp_sql
from .parsers import first_of_each

# The names that each canonical field goes by.
FIELD_NAMES: dict[str, list[str]] = {
    "timestamp": ["timestamp", "time", "ts", "date", "datetime", "@timestamp", "eventtime", "event_time", "logtime", "timecreated"],
    "host": ["host", "hostname", "device", "devname", "machine", "server", "dvc", "computer", "source_host", "computername", "workstation", "workstationname"],
    "source": ["source", "log_source", "sourcetype"],
    "username": ["user", "username", "user_name", "account", "uid", "userid", "user_id", "login", "usr", "accountname", "samaccountname", "targetusername",
        "subjectusername", "target_user"],
    "email": ["email", "mail", "email_address", "user_email", "emailaddress"],
    "source_ip": ["src_ip", "srcip", "source_ip", "sourceip", "source_address", "client_ip", "clientip", "remote_ip", "remote_addr", "remoteip", "src", "ip",
        "ipaddress", "sourceaddress", "c_ip", "cip", "sourcenetworkaddress", "callingstationid"],
    "destination_ip": ["dst_ip", "dstip", "destination_ip", "destip", "dest_ip", "dest_addr", "dst", "server_ip", "target_ip", "destinationaddress", "s_ip"],
    "source_port": ["src_port", "srcport", "source_port", "sport", "spt", "client_port", "ipport"],
    "destination_port": ["dst_port", "dstport", "destination_port", "dport", "dpt", "server_port", "port"],
    "protocol": ["protocol", "proto", "ip_proto", "transport"],
    "event_type": ["event", "event_type", "eventtype", "event_name", "eventname", "type", "category", "activity"],
    "action": ["action", "act", "operation", "verb"],
    "status": ["status", "result", "outcome", "disposition"],
    "severity": ["severity", "level", "lvl", "loglevel", "priority", "log_level"],
    "process": ["process", "proc", "program", "cmd", "logger", "module", "component"],
    "service": ["application", "app", "service", "svc", "facility"],
    "url": ["url", "uri", "path", "request_uri", "requesturl", "request", "cs_uri_stem"],
    "http_method": ["http_method", "method", "verb_http", "cs_method", "request_method"],
    "response_code": ["response_code", "status_code", "statuscode", "http_status", "sc_status", "resp_code"],
    "message": ["message", "msg", "text", "description", "detail", "log", "raw_message", "body"],
}
ALIASES = {alias: name for name, aliases in FIELD_NAMES.items() for alias in aliases}
# The names that each severity goes by.
LEVEL_NAMES: dict[str, list[str]] = {
    "critical": ["0", "1", "2", "emerg", "emergency", "panic", "alert", "crit", "critical", "fatal"],
    "high": ["3", "err", "error", "severe", "high"],
    "medium": ["4", "warn", "warning", "medium"],
    "low": ["5", "notice", "low"],
    "info": ["6", "7", "info", "informational", "information", "debug", "trace", "verbose", "fine"],
}
SEVERITIES = {alias: level for level, aliases in LEVEL_NAMES.items() for alias in aliases}
# Event types by other names, and what an event type says of action, status and severity.
EVENT_TYPES = {
    "auth_failure": "authentication_failure", "authfail": "authentication_failure", "login_failed": "authentication_failure",
    "failed_login": "authentication_failure", "auth_success": "authentication_success", "login_success": "authentication_success",
    "logon": "authentication_success", "login": "authentication_success", "request": "http_request", "http": "http_request",
    "access": "http_request", "deny": "connection_denied", "denied": "connection_denied", "block": "connection_denied",
    "allow": "connection_allowed", "accept": "connection_allowed", "permit": "connection_allowed",
}
ACTION_OF = {
    "authentication_failure": "login", "authentication_success": "login", "session_opened": "login", "session_closed": "logout", "connection_denied": "deny",
    "connection_allowed": "allow", "account_locked": "lock", "http_request": "request",
}
STATUS_OF = {
    "authentication_failure": "failure", "authentication_success": "success", "session_opened": "success", "session_closed": "success",
    "connection_denied": "blocked", "connection_allowed": "allowed", "account_locked": "locked",
}
SEVERITY_OF = {"account_locked": "high", "privilege_escalation": "medium"}
LEVELS = ("info", "low", "medium", "high", "critical")
IP_FIELDS = ["source_ip", "destination_ip", "src_ip", "dst_ip", "ip", "ipaddress", "client_ip", "remote_addr"]
PORT_FIELDS = ["source_port", "destination_port", "src_port", "dst_port", "port", "spt", "dpt", "sport", "dport", "ipport"]
TIME_FIELDS = ["timestamp", "time", "ts", "date", "datetime", "@timestamp", "eventtime", "timecreated", "event_time"]
CODE_FIELDS = ["response_code", "status_code", "http_status"]
NUMBERS = ("source_port", "destination_port", "response_code")
TEXTS = ("host", "username", "email", "source_ip", "destination_ip", "protocol", "action", "status", "process", "service", "url", "http_method")
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
ADDRESS = rf"\b{IPV4}\b"
MAC = r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b"
URL = r"\bhttps?://[^\s\"'<>]+"
REQUEST_ID = r"\b(?:request|req|trace|correlation|session)[_-]?id[=:\s\"]+([A-Za-z0-9\-]{6,})"


#: What makes a value change when it is cleaned: control characters, white space that is not one space, space or a quote at an end.
_UNTIDY = r"[\x00-\x1f\x7f]|\s\s|[^\S ]|^[\s\"']|\s$"


def cleaned_text(v: Column) -> Column:
    """Control characters out, white space collapsed, a pair of quotes around it off; null when nothing is left."""
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, CONTROL, ""), r"\s+", " "))
    unquoted = lambda x: F.when((F.length(x) >= 2) & x.rlike(r"^(?:\".*\"|'.*')$"), x.substr(F.lit(2), F.length(x) - 2)).otherwise(x)
    return empty_to_null(F.when(v.rlike(_UNTIDY), let(let(v, bare), unquoted)).otherwise(v))


#: Stands between texts that are looked through together, and around them; a text that holds it counts as untidy.
_MARK = "\ufdd1"
#: What an untidy text holds among others (see _UNTIDY; all white space but the space is among the control characters).
_UNTIDY_AMONG = ("  ", _MARK + " ", _MARK + '"', _MARK + "'", " " + _MARK, _MARK + _MARK)
#: Names that are looked up by another name, or checked; and names that the event has no use for.
_OTHER_NAMES = sorted({*ALIASES, *TIME_FIELDS, *IP_FIELDS, *PORT_FIELDS, *CODE_FIELDS} - {*FIELD_NAMES})
_ASIDE = ("_rule", "_syslog_severity_num")


def _plain(df: DataFrame, reference: str) -> tuple[DataFrame, Column, Column]:
    """df with columns for two expressions: whether cleaning leaves `fields` as it is and every field that the event takes goes by its own name, and for such lines the field
    timestamp as a time. Most lines are plain. What is here looks at all texts of a line together, in generated code; cleaning and naming are interpreted for each field.

    Each projection of a wide line has a lambda: Spark makes one method of a projection without, which may be too long for the JVM to compile."""
    value = lambda k: F.try_element_at("fields", F.lit(k))
    own = {c: F.col(f"__own_{c}") for c in ("timestamp", "source_ip", "destination_ip", "source_port", "destination_port", "response_code")}
    renamed = F.exists(F.map_keys("fields"), lambda k: k.isin(*_OTHER_NAMES) | k.startswith("kv_") | (k.startswith("_") & ~k.isin(*_ASIDE)))
    texts = F.concat(F.lit(_MARK), F.array_join(F.map_values("fields"), _MARK, " "), F.lit(_MARK))
    df = df.withColumns({"__renamed": renamed, "__keys": F.array_join(F.map_keys("fields"), "\x1f"), "__texts": texts} | {f"__own_{c}": value(c) for c in own})
    first, closed = common_sql("__own_timestamp", reference)
    addresses = F.forall(F.array(own["source_ip"], own["destination_ip"]), lambda x: x.isNull() | valid_ipv4(x))
    fits = [~F.col("__renamed"), F.col("__keys") == F.lower("__keys"), ~contains_any(F.col("__texts"), *_UNTIDY_AMONG), F.col("__texts").rlike(r"^\P{Cntrl}*+\z"), addresses]
    fits += [own[c].isNull() | valid_port(own[c]) for c in ("source_port", "destination_port")] + [own["response_code"].isNull() | to_int(own["response_code"]).isNotNull()]
    df = df.withColumns({"__fits": F.coalesce(all_of(*fits), F.lit(False)), "__moment": F.expr(first)}).drop("__renamed", "__keys", "__texts", *[f"__own_{c}" for c in own if c != "timestamp"])
    return df, F.col("__fits") & (own["timestamp"].isNull() | F.col("__moment").isNotNull()), F.expr(closed)


def cleaned(df: DataFrame, reference: str, ready: bool = False) -> DataFrame:
    """df with its map `fields` cleaned; values that their field cannot hold move to <field>_raw, addresses are written in their one spelling. With ready, __plain and __time
    (see _plain) stay for normalize."""
    df, plain, time = _plain(df, reference)
    checked = {"t": TIME_FIELDS, "i": IP_FIELDS, "p": PORT_FIELDS, "c": CODE_FIELDS}
    kinds = {k: kind for kind, keys in checked.items() for k in keys}
    entry = lambda e: F.struct(e["key"].alias("key"), cleaned_text(e["value"]).alias("value"), lookup(F.lower(e["key"]), kinds).alias("kind"))
    tidy = F.filter(F.transform(F.map_entries("fields"), entry), lambda e: e["value"].isNotNull())
    df = df.withColumns({"__tidy": F.when(~plain, tidy), "__plain": plain, "__time": time}).drop("__fits", "__moment", "__own_timestamp")
    # most kinds are null, and AND evaluates what follows a null: only CASE keeps other fields from being read as times
    late = F.expr(f"transform(__tidy, e -> CASE WHEN e.kind = 't' THEN ({timestamp_sql('e.value', reference)}) IS NULL ELSE false END)")

    def last(e: Column, late: Column) -> Column:
        v, kind = e["value"], e["kind"]
        bad = F.when(kind == "i", ~valid_ip(v)).when(kind == "p", ~valid_port(v)).when(kind == "c", to_int(v).isNull()).otherwise(late)
        shown = F.when(kind == "i", F.when(v.contains(":") & valid_ip(v), canonical_ip(v)).otherwise(v)).otherwise(v)
        return F.struct(F.when(F.coalesce(bad, F.lit(False)), F.concat(e["key"], F.lit("_raw"))).otherwise(e["key"]).alias("key"), shown.alias("value"))

    done = df.withColumn("fields", F.when(F.col("__plain"), F.col("fields")).otherwise(F.map_from_entries(F.zip_with("__tidy", late, last)))).drop("__tidy")
    return done if ready else settled(done.drop("__plain", "__time"))


def extracted(df: DataFrame, line: str = "content") -> DataFrame:
    """df (fields, parse_confidence) with gaps filled from the text, and field_confidence."""
    has = lambda *ks: any_of(*[F.map_contains_key("fields", F.lit(k)) for k in ks])
    raw = F.coalesce(F.col(line), F.lit(""))
    text = F.coalesce(F.try_element_at("fields", F.lit("message")), raw)
    free = ~has("source_ip", "src_ip", "ipaddress")
    # patterns run here, in generated code, on lines that hold what they need; the filter below sees plain columns
    first = lambda c, p, i, *needed: F.when(contains_any(c, *needed), empty_to_null(F.regexp_extract(c, p, i)))
    df = df.withColumns({
        "__ips": F.when(free & raw.contains("."), F.regexp_extract_all(raw, F.lit(f"({ADDRESS})"), 1)), "__email": F.when(~has("email"), first(text, EMAIL, 0, "@")),
        "__request_id": F.when(~has("request_id"), first(raw, REQUEST_ID, 1, "id")), "__url": F.when(~has("url"), first(text, URL, 0, "://")),
        "__mac_address": F.when(~has("mac", "mac_address"), F.when(F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit(":"), F.lit(""))) >= 5, first(raw, MAC, 0, ":"))), "__message": F.when(~has("message"), F.trim(raw)), "__aimed": has("destination_ip"),
        "__base": F.transform_values("fields", lambda k, v: F.bround(F.greatest(F.lit(0.5), F.col("parse_confidence")), 3)),
    })
    found = {
        "email": (F.col("__email"), 0.8), "source_ip": (F.get("__ips", F.lit(0)), 0.6), "destination_ip": (F.when(~F.col("__aimed"), F.get("__ips", F.lit(1))), 0.45),
        "request_id": (F.col("__request_id"), 0.75), "url": (F.col("__url"), 0.7), "mac_address": (F.col("__mac_address"), 0.7), "message": (F.col("__message"), None),
    }
    # none of these fields is there yet
    rows = lambda of: F.map_filter(F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    more = rows({k: F.when(v.isNotNull(), F.lit(c).cast("double")) for k, (v, c) in found.items() if c is not None})
    values = {k: v for k, (v, _) in found.items()}
    some = any_of(*[v.isNotNull() for v in values.values()])
    df = df.withColumns({"field_confidence": F.when(some, F.map_concat("__base", more)).otherwise(F.col("__base")), "fields": F.when(some, F.map_concat("fields", rows(values))).otherwise(F.col("fields"))})
    return df.drop("__ips", "__email", "__request_id", "__url", "__mac_address", "__message", "__aimed", "__base")


@dataclass(frozen=True)
class PiiConfig:
    mode: str = "OFF"  # OFF, MASK or DETERMINISTIC_HASH
    key: str | None = None  # the secret of the pseudonyms; there is no default
    scope: str = "global"
    length: int = 6
    kinds: tuple[str, ...] = ("ip", "email", "username")

    def __post_init__(self):
        if self.mode == "DETERMINISTIC_HASH" and not self.key:
            raise ValueError("DETERMINISTIC_HASH needs a secret key")


KIND_OF = {"source_ip": "ip", "destination_ip": "ip", "email": "email", "username": "username", "host": "host"}
PREFIX = {"ip": "IP", "email": "EMAIL", "username": "USER", "host": "HOST"}


def pseudonym(v: Column, kind: str, cfg: PiiConfig) -> Column:
    digest = hmac_sha256(cfg.key, F.concat(F.lit(f"{cfg.scope}:{kind}:"), F.lower(F.trim(v))))
    return F.concat(F.lit(PREFIX.get(kind, kind.upper()) + "_"), F.upper(F.left(digest, F.lit(cfg.length))))


def pseudonym_of(value: str, kind: str, cfg: PiiConfig) -> str:
    """The pseudonym of one value, for query terms."""
    return f"{PREFIX.get(kind, kind.upper())}_{hmac_of(cfg.key, f'{cfg.scope}:{kind}:{value.strip().lower()}')[: cfg.length].upper()}"


def masked(v: Column, kind: str) -> Column:
    v = F.trim(v)
    if kind == "ip":
        four = F.concat_ws(".", F.split_part(v, F.lit("."), F.lit(1)), F.split_part(v, F.lit("."), F.lit(2)), F.lit("x"), F.lit("x"))
        return F.when(v.contains(":"), F.concat(F.split_part(v, F.lit(":"), F.lit(1)), F.lit(":xxxx::xxxx"))).when(F.size(F.split(v, r"\.")) == 4, four).otherwise("x.x.x.x")
    if kind == "email":
        return F.when(v.contains("@"), F.concat(F.left(v, F.lit(1)), F.lit("***@"), F.regexp_replace(v, r"^[^@]*@", ""))).otherwise("***")
    return F.concat(F.left(v, F.lit(1)), F.lit("***"))


def protect(df: DataFrame, cfg: PiiConfig) -> DataFrame:
    """Replaces identifier columns by pseudonyms or masks; adds pii_mode and pii_protected."""
    done = {}
    for c, kind in KIND_OF.items():
        if cfg.mode != "OFF" and kind in cfg.kinds and c in df.columns:
            done[c] = pseudonym(F.col(c), kind, cfg) if cfg.mode == "DETERMINISTIC_HASH" else masked(F.col(c), kind)
    changed = F.exists(F.array(*[F.col(c).isNotNull() for c in done]), lambda x: x) if done else F.lit(False)
    return df.withColumns({"pii_mode": F.lit(cfg.mode), "pii_protected": changed}).withColumns(done)


def preview(df: DataFrame, cfgs: dict[str, PiiConfig]) -> DataFrame:
    """What settings would make of the identifiers of rows, one row per row and identifier that is there: the columns that are no identifiers, field, value, and
    a column for each named configuration. Nothing is stored."""
    known = [c for c in KIND_OF if c in df.columns]
    rest = [c for c in df.columns if c not in known]
    shown = [F.struct(F.lit(c).alias("field"), F.col(c).alias("value"), *[protected_value(F.col(c), KIND_OF[c], cfg).alias(name) for name, cfg in cfgs.items()]) for c in known]
    rows = df.select(*rest, F.explode(F.array(*shown)).alias("x")).select(*rest, "x.*")
    return rows.where("value IS NOT NULL")


def protected_value(v: Column, kind: str, cfg: PiiConfig) -> Column:
    """A value as protect writes it under a configuration."""
    if cfg.mode == "OFF" or kind not in cfg.kinds:
        return v
    return pseudonym(v, kind, cfg) if cfg.mode == "DETERMINISTIC_HASH" else masked(v, kind)


def severity_of(v: Column) -> Column:
    return lookup(F.lower(F.trim(v)), SEVERITIES)


def event_type_of(v: Column) -> Column:
    low = F.regexp_replace(F.lower(F.trim(v)), " ", "_")
    return empty_to_null(F.coalesce(lookup(low, EVENT_TYPES), low))


def normalize(df: DataFrame, reference: str) -> DataFrame:
    """df (fields, parsed_event_type, ...) with the canonical columns and extra. Of fields that mean the same, the last counts."""
    if "__plain" not in df.columns:
        df = df.withColumns({"__plain": F.lit(False), "__time": F.lit(None).cast("timestamp")})
    plain = F.col("__plain")
    entries = F.map_entries("fields")
    hidden = lambda k: F.lower(k).startswith("_") | F.lower(k).startswith("kv_")
    named = F.transform(F.filter(entries, lambda e: ~hidden(e["key"])), lambda e: F.struct(lookup(F.lower(e["key"]), ALIASES).alias("name"), e["key"].alias("key"), e["value"].alias("value")))
    # each raw value is a column of its own before anything is made of it, found by its place in the reversed names
    df = df.withColumn("__named", F.when(~plain, F.reverse(named)))
    df = df.withColumns({"__names": F.transform("__named", lambda e: F.coalesce(e["name"], F.lit(""))), "__values": F.transform("__named", lambda e: e["value"])})
    at = lambda name: F.array_position("__names", F.lit(name)).cast("int")
    own = lambda c: F.try_element_at("fields", F.lit(c))
    first = {c: F.when(plain, own(c)).otherwise(F.get("__values", at(c) - 1)) for c in (*TEXTS, *NUMBERS, "timestamp", "event_type", "severity", "message")}
    # the severity is worked out here for its lambda (see _plain): every query that asks for many of these columns asks for it, as valid rests on it
    first["severity"] = severity_of(first["severity"])
    apart = F.map_filter("fields", lambda k, v: ~k.isin(*[c for c in FIELD_NAMES if c != "source"], *_ASIDE))
    df = df.withColumns({f"__raw_{c}": v for c, v in first.items()} | {"__apart": F.when(plain, apart)}).drop("__names", "__values")
    raw = {c: F.col(f"__raw_{c}") for c in first}
    df = df.withColumn("__event", F.coalesce(event_type_of(raw["event_type"]), event_type_of(F.col("parsed_event_type"))))
    event = F.col("__event")
    cols = {c: raw[c] for c in TEXTS} | {c: to_int(raw[c]) for c in NUMBERS}
    cols["protocol"] = F.lower(raw["protocol"])
    cols["action"], cols["status"] = F.coalesce(raw["action"], lookup(event, ACTION_OF)), F.coalesce(raw["status"], lookup(event, STATUS_OF))
    cols["severity"] = F.coalesce(raw["severity"], lookup(event, SEVERITY_OF))
    cols |= {"timestamp": F.when(plain, F.col("__time")).otherwise(parse_timestamp("__raw_timestamp", reference)), "event_type": event, "message": F.coalesce(raw["message"], F.lit(""))}
    rest = F.filter(F.reverse("__named"), lambda e: e["name"].isNull() | (e["name"] == "source"))
    rest = F.transform(rest, lambda e: F.struct(e["key"], e["value"]))
    kept = F.transform(F.filter(entries, lambda e: hidden(e["key"]) & ~e["key"].isin(*_ASIDE)), lambda e: F.struct(F.regexp_replace(e["key"], "^_+", "").alias("key"), e["value"]))
    dropped = F.array(*[F.struct(F.lit(f"{c}_raw").alias("key"), F.when(to_int(raw[c]).isNull(), raw[c]).alias("value")) for c in NUMBERS])
    cols["extra"] = F.when(plain, F.col("__apart")).otherwise(first_of_each(F.concat(rest, kept, F.filter(dropped, lambda e: e["value"].isNotNull()))))
    return df.withColumns(cols).drop("__named", "__event", "__plain", "__time", "__apart", *[f"__raw_{c}" for c in raw])


def validated(df: DataFrame) -> DataFrame:
    """Adds confidence, processing_status and valid: values outside a range or vocabulary make a row invalid."""
    values = F.map_values("field_confidence")
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).otherwise(0.0)
    total = 0.5 * F.col("parse_confidence") + 0.3 * F.col("format_confidence") + 0.2 * mean
    ranges = [F.coalesce(F.col(c).between(0, top), F.lit(True)) for c, top in (("source_port", 65535), ("destination_port", 65535), ("response_code", 599))]
    nothing = F.coalesce(*[F.col(c).cast("string") for c in (*TEXTS, *NUMBERS, "timestamp")]).isNull()
    return df.withColumns({
        "confidence": F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 3),
        "processing_status": F.when((F.col("parser") == "raw") | nothing, "partial").otherwise("ok"),
        "valid": ranges[0] & ranges[1] & ranges[2] & F.coalesce(F.col("severity").isin(*LEVELS), F.lit(True)),
    })
