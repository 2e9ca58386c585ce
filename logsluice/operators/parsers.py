"""Line parsers as Column expressions, and the choice among them.

A parser is a ParserSpec: a score for a line, from 0 to 1, and the fields that it reads from one as a map of texts. All parsers are
Column expressions over the line; the fields of a parser are computed only for its lines. What a parser matches is kept in a column
before fields are made of it, so that a pattern runs once per line however many groups it has. Before a pattern is tried, cheap
searches for plain texts that it needs anyway rule most lines out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of, capture, captured, contains_any, empty_to_null, lookup
from ..functions.store import settled
from ..functions.times import let

Fields = dict[str, Column]


@dataclass(frozen=True)
class ParserSpec:
    name: str
    format: str
    specificity: int
    score: Callable[[Column], Column]
    #: (fields, confidence, event type) of a line and of what was prepared
    parse: Callable[..., tuple[Column, Column, Column]]
    version: str = "1.0.0"
    description: str = ""
    #: Maps of texts that are made of the line, and of those before, one after the other
    prepare: tuple[Callable[..., Column], ...] = ()
    #: Whether the score of a line is 1, where that is cheaper to tell than the score
    sure: Callable[[Column], Column] | None = None


def field_map(fields: Fields) -> Column:
    """A map of the fields that are not null."""
    return F.map_filter(open_map(fields), lambda k, v: v.isNotNull())


def open_map(fields: Fields) -> Column:
    """A map of the fields, null ones too, in generated code: what is filtered is interpreted with all that it is made of. parse_steps takes the nulls out."""
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])


def pair_map(pairs: Column, names: dict[str, str], keep_first: bool = False) -> Column:
    """A map from (key, value) pairs: keys in lower case through the table, others with the prefix kv_. Of pairs that share a
    name the last counts, or the first."""
    named = F.transform(pairs, lambda p: F.struct(F.coalesce(lookup(F.lower(p["key"]), names), F.concat(F.lit("kv_"), F.lower(p["key"]))).alias("key"), p["value"].alias("value")))
    return first_of_each(named if keep_first else F.reverse(named))


def pairs_of(line: Column, key: str, value: str = r'(?:"[^"]*"|\S+)') -> Column:
    """All key=value pairs of a line, quotes taken off."""
    found = F.regexp_extract_all(line, F.lit(rf"((?:{key})={value})"), 1)
    cut = lambda p: F.regexp_replace(p, r"^[^=]*=", "")
    bare = lambda v: F.when(v.rlike(r"^\".*\"$|^'.*'$"), F.regexp_replace(v, r"^[\"']|[\"']$", "")).otherwise(v)
    return F.transform(found, lambda p: F.struct(F.regexp_extract(p, r"^([^=]*)=", 1).alias("key"), let(cut(p), bare).alias("value")))


def seen(line: Column, pattern: str, *texts: str) -> Column:
    """Whether the pattern matches; it is tried only on lines that hold one of some plain texts."""
    return contains_any(line, *texts) & line.rlike(pattern) if texts else line.rlike(pattern)


def _tests(line: Column, patterns: list) -> Column:
    return any_of(*[seen(line, *((p,) if isinstance(p, str) else p)) for p in patterns])


def _score(patterns: list, hints: list) -> Callable[[Column], Column]:
    """Patterns and hints are texts, or tuples of a pattern and plain texts (see seen)."""

    def score(line: Column) -> Column:
        hit = F.when(_tests(line, patterns), 1.0).otherwise(0.0)
        bonus = F.when(_tests(line, hints), 0.15).otherwise(0.0) if hints else F.lit(0.0)
        return F.bround(F.least(F.lit(1.0), hit + bonus), 3)

    return score


# The patterns of the formats. Groups are positional, their names follow each pattern.
BSD_TIME = r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
AUTH = rf"^({BSD_TIME})\s+([\w.\-]+)\s+(sshd|sudo|su|login|systemd-logind|pam_unix|CRON)(?:\[(\d+)\])?:\s*(.*)$"
AUTH_TESTS = [(AUTH, "sshd", "su", "login", "pam_unix", "CRON")]
AUTH_NAMES = ("timestamp", "host", "process", "pid", "message")
AUTH_HINTS = [(r"\bsshd\[\d+\]:", "sshd["), (r"Failed password for", "Failed password for"), (r"Accepted password for", "Accepted password for"), (r"pam_unix\(", "pam_unix("), (r"sudo:\s+\S+ : TTY=", "sudo:")]
#: A text that each of the messages below holds, in lower case.
AUTH_TEXTS = ("failed password for", "accepted ", "invalid user", "authentication failure;", "session opened for user", "session closed for user", " : tty=")
AUTH_MESSAGES = [
    ("auth_fail_pw", r"(?i)Failed password for (?:invalid user )?(\S+) from ([\da-fA-F.:]+) port (\d+)", ("username", "source_ip", "source_port"), {"event_type": "authentication_failure", "action": "login", "status": "failure", "service": "ssh"}),
    ("auth_ok_pw", r"(?i)Accepted (?:password|publickey) for (\S+) from ([\da-fA-F.:]+) port (\d+)", ("username", "source_ip", "source_port"), {"event_type": "authentication_success", "action": "login", "status": "success", "service": "ssh"}),
    ("invalid_user", r"(?i)Invalid user (\S+) from ([\da-fA-F.:]+)(?: port (\d+))?", ("username", "source_ip", "source_port"), {"event_type": "authentication_failure", "action": "login", "status": "failure", "service": "ssh"}),
    ("pam_fail", r"(?i)authentication failure;.*?rhost=([\da-fA-F.:]*)\s*(?:user=(\S+))?", ("source_ip", "username"), {"event_type": "authentication_failure", "action": "login", "status": "failure"}),
    ("session_open", r"(?i)session opened for user (\S+)", ("username",), {"event_type": "session_opened", "action": "login", "status": "success"}),
    ("session_close", r"(?i)session closed for user (\S+)", ("username",), {"event_type": "session_closed", "action": "logout", "status": "success"}),
    ("sudo_cmd", r"(?i)(\S+) : TTY=\S+ ; PWD=\S+ ; USER=(\S+) ; COMMAND=(.+)$", ("username", "target_user", "command"), {"event_type": "privilege_escalation", "action": "sudo", "service": "sudo"}),
]
RFC5424 = r"^<(\d{1,3})>(\d)\s+(\d{4}-\d{2}-\d{2}T[\d:.]+(?:Z|[+\-]\d{2}:\d{2}))\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:\[.*?\]|-)\s*(.*)$"
RFC5424_NAMES = ("pri", "version", "timestamp", "host", "process", "pid", "msgid", "message")
RFC3164 = rf"^(?:<(\d{{1,3}})>)?({BSD_TIME})\s+([\w.\-]+)\s+([^:\[\s]+)(?:\[(\d+)\])?:\s*(.*)$"
RFC3164_NAMES = ("pri", "timestamp", "host", "process", "pid", "message")
SYSLOG_TESTS = [(RFC5424, "<"), RFC3164]
SYSLOG_HINTS = [(r"^<\d{1,3}>", "<"), r"[A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}:\d{2}\s\S+\s\S+"]
APACHE = r'^([\da-fA-F.:]+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)\s+([^"]+)"\s+(\d{3})\s+(\d+|-)(?:\s+"([^"]*)"\s+"([^"]*)")?'
WEB_NAMES = ("source_ip", "username", "timestamp", "http_method", "url", "http_version", "response_code", "bytes", "referer", "user_agent")
APACHE_TESTS = [(APACHE, '"')]
APACHE_HINTS = [(r'"\s*(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\s+\S+\s+HTTP/\d', "HTTP/"), r"\[\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}\s[+\-]\d{4}\]"]
_NGINX = r'^([\da-fA-F.:]+)\s+-\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)\s+([^"]+)"\s+(\d{3})\s+(\d+)\s+"([^"]*)"\s+"([^"]*)"'
NGINX_EXTENDED = _NGINX + r'\s+"([^"]*)"(?:\s+rt=([\d.]+))?(?:\s+uct="([^"]*)")?(?:\s+urt="([^"]*)")?'
NGINX_NAMES = (*WEB_NAMES, "x_forwarded_for", "request_time", "upstream_connect_time", "upstream_response_time")
NGINX_TESTS = [(_NGINX, '"')]
NGINX_HINTS = [(r'"\s*-\s*"\s+rt=', "rt="), r'urt="', (r'\s"[\d.]+,\s*[\d.]+"\s*$', ",")]
NETFILTER = r"(?i)\b(DROP|ACCEPT|REJECT|DENY)\b.*SRC=(\S+)\s+DST=(\S+)"
FIREWALL_HINT = r"(?i)\b(?:IPTABLES|netfilter|SRC=\d|DPT=\d|action=(?:deny|accept|allow|drop)|srcip=|dstip=|devname=|firewall|fw_action)\b"
FIREWALL_KEYS = {
    "srcip": "source_ip", "src": "source_ip", "src_ip": "source_ip", "dstip": "destination_ip", "dst": "destination_ip",
    "dst_ip": "destination_ip", "srcport": "source_port", "spt": "source_port", "dstport": "destination_port",
    "dpt": "destination_port", "proto": "protocol", "protocol": "protocol", "action": "fw_action", "act": "fw_action",
    "disposition": "fw_action", "user": "username", "usr": "username", "devname": "host", "hostname": "host", "dvc": "host",
    "service": "service", "app": "service", "svc": "service",
}
PROTOCOL_NUMBERS = {"6": "tcp", "17": "udp", "1": "icmp"}
JSON_KEYS = {
    "ts": "timestamp", "time": "timestamp", "@timestamp": "timestamp", "eventTime": "timestamp", "datetime": "timestamp", "date": "timestamp",
    "level": "severity", "lvl": "severity", "loglevel": "severity", "priority": "severity", "msg": "message", "text": "message",
    "log": "message", "logger": "process", "module": "process", "component": "process", "user": "username", "userName": "username",
    "account": "username", "uid": "username", "email": "email", "mail": "email", "src_ip": "source_ip", "srcIp": "source_ip",
    "clientIp": "source_ip", "client_ip": "source_ip", "remote_addr": "source_ip", "ip": "source_ip", "sourceAddress": "source_ip",
    "dst_ip": "destination_ip", "destIp": "destination_ip", "serverIp": "destination_ip", "src_port": "source_port",
    "dst_port": "destination_port", "method": "http_method", "httpMethod": "http_method", "path": "url", "uri": "url",
    "requestUrl": "url", "url": "url", "status": "response_code", "statusCode": "response_code", "http_status": "response_code",
    "event": "event_type", "eventType": "event_type", "action": "action", "type": "event_type", "host": "host", "hostname": "host",
    "server": "host", "service": "service", "svc": "service", "app": "service", "application": "service",
}
JSON_LEVELS = {
    "trace": "info", "debug": "info", "info": "info", "notice": "low", "warn": "medium", "warning": "medium", "error": "high", "err": "high",
    "crit": "critical", "critical": "critical", "fatal": "critical", "alert": "critical", "emerg": "critical",
}
PAIR_KEYS = {
    "src_ip": "source_ip", "srcip": "source_ip", "client_ip": "source_ip", "remote_ip": "source_ip", "dst_ip": "destination_ip",
    "dest_ip": "destination_ip", "src_port": "source_port", "dst_port": "destination_port", "user": "username", "usr": "username",
    "account": "username", "lvl": "severity", "level": "severity", "msg": "message", "message": "message", "proto": "protocol",
    "method": "http_method", "status": "response_code", "code": "response_code", "path": "url", "uri": "url", "event": "event_type",
    "action": "action", "host": "host", "hostname": "host", "service": "service", "svc": "service",
}


def _said(text: Column, turn: int) -> Column:
    """Whether a text holds the message of AUTH_MESSAGES with this number."""
    return F.lower(text).contains(AUTH_TEXTS[turn]) & text.rlike(AUTH_MESSAGES[turn][1])


def _auth_score(line: Column) -> Column:
    known = any_of(*[_said(line, i) for i in range(len(AUTH_MESSAGES))])
    return F.bround(F.least(F.lit(1.0), _score(AUTH_TESTS, AUTH_HINTS)(line) + F.when(known, 0.25).otherwise(0.0)), 3)


def _auth_head(line: Column) -> Column:
    return captured(line, AUTH, AUTH_NAMES)


def _auth_message(line: Column, head: Column) -> Column:
    """What the first message that fits says. Groups that are missing are null; none of them goes by a name of the head."""
    message, found = F.coalesce(F.try_element_at(head, F.lit("message")), F.lit("")), None
    for i, (name, pattern, names, extra) in enumerate(AUTH_MESSAGES):
        fields = open_map(capture(message, pattern, names) | {k: F.lit(v) for k, v in extra.items()} | {"_rule": F.lit(name)})
        found = F.when(_said(message, i), fields) if found is None else found.when(_said(message, i), fields)
    return found


def parse_auth(line: Column, head: Column, said: Column):
    # the service is the only name that both may go by; said is null where no message fits
    served = F.map_contains_key(head, F.lit("process")) & ~F.coalesce(F.map_contains_key(said, F.lit("service")), F.lit(False))
    base = F.when(served, F.map_concat(head, F.create_map(F.lit("service"), F.try_element_at(head, F.lit("process"))))).otherwise(head)
    fields = F.when(said.isNull(), base).otherwise(F.map_concat(base, said))
    return fields, F.when(said.isNotNull(), 0.97).otherwise(0.7), F.coalesce(F.try_element_at(said, F.lit("event_type")), F.lit("generic"))


def _syslog_groups(line: Column) -> Column:
    new, old = captured(line, RFC5424, RFC5424_NAMES), captured(line, RFC3164, RFC3164_NAMES)
    return F.when(line.startswith("<") & line.rlike(RFC5424), new).otherwise(old)


def parse_syslog(line: Column, groups: Column):
    f = {k: F.try_element_at(groups, F.lit(k)) for k in RFC5424_NAMES}
    level = F.try_to_number(F.coalesce(f.pop("pri"), F.lit("")), F.lit("999")).cast("int") % 8
    f["severity"] = F.when(level <= 2, "critical").when(level == 3, "high").when(level == 4, "medium").when(level == 5, "low").when(level >= 6, "info")
    f["_syslog_severity_num"] = level.cast("string")
    f["service"] = f["process"]
    said = F.lower(F.coalesce(f["message"], F.lit("")))
    event = F.when(said.contains("authentication failure") | said.contains("failed password"), "authentication_failure")
    event = event.when(said.contains("accepted password") | said.contains("session opened"), "session_opened").otherwise("generic")
    return open_map(f), F.lit(0.9), event


def _web(f: Fields) -> Fields:
    code = f["response_code"].cast("int")
    f["username"] = F.when(f["username"] != "-", f["username"])
    f["service"], f["protocol"] = F.lit("http"), F.lit("tcp")
    f["severity"] = F.when(code >= 500, "high").when(code >= 400, "medium")
    f["status"] = F.when(code >= 400, "failure").when(code.isNotNull(), "success")
    return f


def parse_apache(line: Column, groups: Column):
    f = _web({k: F.try_element_at(groups, F.lit(k)) for k in WEB_NAMES})
    f["bytes"] = F.when(f["bytes"] == "-", "0").otherwise(f["bytes"])
    return open_map(f), F.lit(0.96), F.lit("http_request")


def _timed(line: Column) -> Column:
    return line.contains("rt=") | line.contains('for" "')


def _nginx_score(line: Column) -> Column:
    return F.bround(_score(NGINX_TESTS, NGINX_HINTS)(line) * F.when(_timed(line), 1.0).otherwise(0.6), 3)


def _nginx_groups(line: Column) -> Column:
    wide, plain = captured(line, NGINX_EXTENDED, NGINX_NAMES), captured(line, _NGINX, WEB_NAMES)
    return F.when(line.rlike(NGINX_EXTENDED), wide).otherwise(plain)


def parse_nginx(line: Column, groups: Column):
    f = _web({k: F.try_element_at(groups, F.lit(k)) for k in NGINX_NAMES})
    f["x_forwarded_for"] = F.when(f["x_forwarded_for"] != "-", f["x_forwarded_for"])
    return open_map(f), F.lit(0.96), F.lit("http_request")


def _vendor(line: Column) -> Column:
    return contains_any(F.lower(line), "srcip=", "src=", "action=", "dpt=", "dstip=", "devname=")


def _netfilter(line: Column) -> Column:
    return F.lower(line).contains("dst=") & line.rlike(NETFILTER)


def _firewall_score(line: Column) -> Column:
    hit = F.when(_vendor(line) | _netfilter(line), 1.0).otherwise(0.0)
    hinted = (line.contains("=") | contains_any(F.lower(line), "iptables", "netfilter", "firewall", "fw_action")) & line.rlike(FIREWALL_HINT)
    return F.bround(F.least(F.lit(1.0), hit + F.when(hinted, 0.2).otherwise(0.0)), 3)


def _firewall_pairs(line: Column) -> Column:
    """Netfilter lines (each field read on its own, so none hides another) and vendor key=value lines."""
    one = lambda p, i=1: empty_to_null(F.regexp_extract(line, p, i))
    f = {
        "timestamp": one(rf"({BSD_TIME})"), "fw_action": one(NETFILTER), "source_ip": one(NETFILTER, 2), "destination_ip": one(NETFILTER, 3),
        "in_if": one(r"\bIN=(\S+)"), "out_if": one(r"\bOUT=(\S+)"), "protocol": one(r"\bPROTO=(\S+)"), "source_port": one(r"\bSPT=(\d+)"),
        "destination_port": one(r"\bDPT=(\d+)"),
    }
    return F.when(_netfilter(line), open_map(f)).otherwise(pair_map(pairs_of(line, r"\w[\w.\-]*"), FIREWALL_KEYS))


def _firewall_base(line: Column, pairs: Column) -> Column:
    when = F.concat_ws(" ", F.try_element_at(pairs, F.lit("kv_date")), F.try_element_at(pairs, F.lit("kv_time")))
    return F.when(when.rlike(r"^\S+ \S+$"), F.map_concat(F.map_filter(pairs, lambda k, v: k != "timestamp"), F.create_map(F.lit("timestamp"), when))).otherwise(pairs)


def parse_firewall(line: Column, pairs: Column, base: Column):
    act = F.lower(F.coalesce(F.try_element_at(base, F.lit("fw_action")), F.lit("")))
    deny, allow = act.isin("drop", "deny", "reject", "block"), act.isin("accept", "allow", "permit")
    event = F.when(deny, "connection_denied").when(allow, "connection_allowed").otherwise("generic")
    protocol = F.lower(F.try_element_at(base, F.lit("protocol")))
    rest = F.map_filter(base, lambda k, v: ~k.isin("fw_action", "protocol", "severity", "service", "event_type", "action", "status"))
    made = open_map({
        "protocol": empty_to_null(F.coalesce(lookup(protocol, PROTOCOL_NUMBERS), protocol)), "event_type": event,
        "action": F.when(deny, "deny").when(allow, "allow").otherwise(empty_to_null(act)), "status": F.when(deny, "blocked").when(allow, "allowed"),
        "severity": F.coalesce(F.try_element_at(base, F.lit("severity")), F.when(deny, "medium").otherwise("info")),
        "service": F.coalesce(F.try_element_at(base, F.lit("service")), F.lit("firewall")),
    })
    return F.map_concat(rest, made), F.when(_netfilter(line), 0.95).otherwise(0.9), event


#: Levels of nested objects that are opened; what lies deeper stays JSON text.
JSON_DEPTH = 12


def _json_pairs(text: Column) -> Column:
    """Leaf keys and values of an object, nested objects opened; lists stay JSON text, at most 500 characters."""
    nested = lambda e: e["value"].contains("{") & e["value"].rlike(r"^\s*\{")
    inner = lambda e: F.map_entries(F.from_json(e["value"], "map<string,string>"))
    once = lambda flat: F.flatten(F.transform(flat, lambda e: F.when(nested(e), F.coalesce(inner(e), F.array(e))).otherwise(F.array(e))))

    def opened(flat: Column, depth: int) -> Column:
        # each level refers to the one before once, and is entered only where something is left to open
        return let(flat, lambda f: F.when(F.exists(f, nested), opened(once(f), depth - 1)).otherwise(f)) if depth else flat

    flat = opened(F.map_entries(F.from_json(text, "map<string,string>")), JSON_DEPTH)
    flat = F.transform(flat, lambda e: F.struct(e["key"], F.when(e["value"].contains("[") & e["value"].rlike(r"^\s*\["), F.left(e["value"], F.lit(500))).otherwise(e["value"]).alias("value")))
    return F.filter(flat, lambda e: e["value"].isNotNull() & (e["value"] != ""))


def _json_fields(line: Column) -> Column:
    named = F.transform(_json_pairs(line), lambda e: F.struct(F.coalesce(lookup(e["key"], JSON_KEYS), lookup(F.lower(e["key"]), JSON_KEYS), F.lower(e["key"])).alias("key"), e["value"].alias("value")))
    return first_of_each(named)


def first_of_each(entries: Column) -> Column:
    """A map of entries (key, value); of those with one key the first counts."""
    return F.transform(F.array(entries), lambda all_of: F.transform(F.array(F.transform(all_of, lambda e: e["key"])), lambda keys: F.map_from_entries(F.filter(all_of, lambda e, i: F.array_position(keys, e["key"]) == i + 1)))[0])[0]


def parse_json(line: Column, fields: Column):
    level = lookup(F.lower(F.try_element_at(fields, F.lit("severity"))), JSON_LEVELS)
    rest = F.map_filter(fields, lambda k, v: k != "severity")
    found = F.when(level.isNotNull(), F.map_concat(rest, F.create_map(F.lit("severity"), level))).otherwise(rest)
    return found, F.lit(0.95), F.try_element_at(fields, F.lit("event_type"))


_PAIR = r"[A-Za-z_][\w.\-]*"
_PAIR_VALUE = r"(?:\"[^\"]*\"|'[^']*'|[^\s]+)"


def _json_sure(line: Column) -> Column:
    return F.trim(line).startswith("{") & F.trim(line).endswith("}") & let(line, lambda x: F.try_parse_json(x).isNotNull())


def _pipe_sure(line: Column) -> Column:
    return line.contains("|") & line.rlike(r"^\d{4}-\d{2}-\d{2}T[^|]*\|[^|]*\|[^|]*\|[^|]*\|[^|]*$")


def _pair_score(line: Column) -> Column:
    found = F.size(F.regexp_extract_all(line, F.lit(rf"({_PAIR}={_PAIR_VALUE})"), 1))
    words = F.greatest(F.lit(1), F.regexp_count(line, F.lit(r"\S+")))
    return F.when(line.contains("="), F.bround(F.least(F.lit(0.75), found / words), 3)).otherwise(0.0)


def _pair_fields(line: Column) -> Column:
    return pair_map(pairs_of(line, _PAIR, _PAIR_VALUE), PAIR_KEYS)


def parse_pairs(line: Column, pairs: Column):
    has = F.map_contains_key(pairs, F.lit("message"))
    fields = F.when(has, pairs).otherwise(F.map_concat(pairs, F.create_map(F.lit("message"), line)))
    return fields, F.least(F.lit(0.7), 0.3 + 0.05 * F.size(fields)), F.try_element_at(pairs, F.lit("event_type"))


def parse_pipes(line: Column):
    """time|host|user|ip|action."""
    at = F.split(line, r"\|")
    names = ("timestamp", "host", "username", "source_ip", "action")
    return open_map({k: empty_to_null(F.trim(F.get(at, F.lit(i)))) for i, k in enumerate(names)}), F.lit(0.9), F.lit("generic")


def parse_raw(line: Column):
    return F.create_map(F.lit("message"), line), F.lit(0.1), F.lit("generic")


def _never(line: Column) -> Column:
    return F.lit(False)


RAW = ParserSpec("raw", "UNKNOWN", 0, lambda line: F.lit(0.01), parse_raw, description="any line as a message", sure=_never)
BUILT_IN = [
    ParserSpec("linux_auth", "LINUX_AUTH", 6, _auth_score, parse_auth, description="sshd, sudo, su and pam lines", prepare=(_auth_head, _auth_message), sure=lambda line: _tests(line, AUTH_TESTS)),
    ParserSpec("syslog", "SYSLOG", 2, _score(SYSLOG_TESTS, SYSLOG_HINTS), parse_syslog, description="RFC 3164 and RFC 5424", prepare=(_syslog_groups,), sure=lambda line: _tests(line, SYSLOG_TESTS)),
    ParserSpec("apache", "APACHE_COMBINED", 4, _score(APACHE_TESTS, APACHE_HINTS), parse_apache, description="common and combined access logs", prepare=(lambda line: captured(line, APACHE, WEB_NAMES),), sure=lambda line: _tests(line, APACHE_TESTS)),
    ParserSpec("nginx", "NGINX_ACCESS", 5, _nginx_score, parse_nginx, description="access logs with forwarding and timing", prepare=(_nginx_groups,), sure=lambda line: _timed(line) & _tests(line, NGINX_TESTS)),
    ParserSpec("firewall", "FIREWALL", 5, _firewall_score, parse_firewall, description="netfilter and vendor key=value lines", prepare=(_firewall_pairs, _firewall_base), sure=lambda line: _vendor(line) | _netfilter(line)),
    ParserSpec("json", "JSON", 4, lambda line: F.when(_json_sure(line), 1.0).otherwise(0.0), parse_json, description="one JSON object per line", prepare=(_json_fields,), sure=_json_sure),
    ParserSpec("keyvalue", "KEYVALUE", 1, _pair_score, parse_pairs, description="key=value lines", prepare=(_pair_fields,), sure=_never),
    ParserSpec("pipe", "PIPE_DELIMITED", 3, lambda line: F.when(_pipe_sure(line), 1.0).otherwise(0.0), parse_pipes, description="five fields between bars", sure=_pipe_sure),
    RAW,
]


def scored(line: Column, parsers: list[ParserSpec]) -> Column:
    """All parsers' scores, best first: (confidence, specificity, turn, format, parser)."""
    rows = [F.struct(p.score(line).alias("confidence"), F.lit(p.specificity).alias("specificity"), F.lit(-i).alias("turn"), F.lit(p.format).alias("format"), F.lit(p.name).alias("parser")) for i, p in enumerate(parsers)]
    return F.sort_array(F.array(*rows), asc=False)


def foremost(line: Column, parsers: list[ParserSpec]) -> Column:
    """The first of scored. No score is above 1, so the most specific parser with that score stands, and those after it are not tried. That of JSON has a lambda, without
    which Spark would make one method of them all, too long for the JVM to compile."""
    row = lambda i, p, score: F.struct(score.alias("confidence"), F.lit(p.specificity).alias("specificity"), F.lit(-i).alias("turn"), F.lit(p.format).alias("format"), F.lit(p.name).alias("parser"))
    found = None
    for i, p in sorted(enumerate(parsers), key=lambda x: (-x[1].specificity, x[0])):
        sure, told = p.sure(line) if p.sure else p.score(line) == 1.0, row(i, p, F.lit(1.0))
        found = F.when(sure, told) if found is None else found.when(sure, told)
    return found.otherwise(F.array_max(F.array(*[row(i, p, p.score(line)) for i, p in enumerate(parsers)])))


def detect(df: DataFrame, line: str = "content", parsers: list[ParserSpec] | None = None, hint: str | None = None, listed: bool = True) -> DataFrame:
    """df with candidates (unless not listed), parser, format and format_confidence per line. A hint wins where its own score is above 0.2;
    below 0.35 a line counts as generic text at 0.3, an empty one as unknown at 0."""
    parsers = parsers or BUILT_IN
    text = F.coalesce(F.col(line), F.lit(""))
    if listed or hint:
        df = df.withColumn("candidates", F.slice(scored(text, parsers), 1, 6))
    best = F.col("candidates")[0] if listed or hint else foremost(text, parsers)
    if hint:
        hinted = F.filter("candidates", lambda c: (c["format"] == hint) & (c["confidence"] > 0.2))
        best = F.coalesce(F.get(hinted, F.lit(0)), best)
    df = df.withColumn("best", best)
    weak, blank = F.col("best.confidence") < 0.35, F.trim(F.coalesce(F.col(line), F.lit(""))) == ""
    return df.select(
        "*",
        F.col("best.parser").alias("parser"),
        F.when(blank, "UNKNOWN").when(weak, "GENERIC_TEXT").otherwise(F.col("best.format")).alias("format"),
        F.when(blank, 0.0).when(weak, 0.3).otherwise(F.col("best.confidence")).alias("format_confidence"),
    ).drop("best", *([] if listed else ["candidates"]))


CSV_SEPARATORS = (",", ";", "\t", "|")
#: Lines that decide whether a file is CSV.
CSV_LINES = 20


def _csv_score(lines: Column) -> Column:
    """How much the first lines of a file look like CSV, by the separator that fits best: 0.85 where all have the same three cells or more, 0.6 where there
    are two widths, 0.2 for other lines with a separator in each, 0 without one or with a single line."""
    scores = []
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r'"[^"]*"', ""))
    for sep in CSV_SEPARATORS:
        mark = F.lit("\\" + sep if sep == "|" else sep)
        widths = F.transform(bare, lambda x: F.regexp_count(x, mark) + 1)  # noqa: B023
        n, most = F.size(F.array_distinct(widths)), F.array_max(widths)
        scores.append(F.when((n == 1) & (most >= 3), 0.85).when((n <= 2) & (most >= 3), 0.6).when(F.array_min(widths) > 1, 0.2).otherwise(0.0))
    return F.when(F.size(lines) >= 2, F.greatest(*scores)).otherwise(0.0)


def file_format(df: DataFrame, by: list[str], line: str = "content", order: str = "line_number", parsers: list[ParserSpec] | None = None, sample: int = 25) -> DataFrame:
    """The format of each file from its first lines that are not blank: mean score per parser, and how much they look like CSV; best first."""
    from pyspark.sql import Window as W

    parsers = parsers or BUILT_IN
    first = df.where(F.trim(F.col(line)) != "").withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(order))).where(F.col("__n") <= sample)
    head = F.sort_array(F.collect_list(F.when(F.col("__n") <= CSV_LINES, F.struct("__n", F.col(line).alias("x")))))
    means = first.groupBy(*by).agg(*[F.bround(F.avg(p.score(F.col(line))), 3).alias(p.name) for p in parsers], F.transform(head, lambda h: h["x"]).alias("__head"))
    rows = [F.struct(F.col(p.name).alias("confidence"), F.lit(p.specificity).alias("specificity"), F.lit(-i).alias("turn"), F.lit(p.format).alias("format")) for i, p in enumerate(parsers)]
    rows.append(F.struct(F.bround(_csv_score(F.col("__head")), 3).alias("confidence"), F.lit(3).alias("specificity"), F.lit(-len(parsers)).alias("turn"), F.lit("CSV").alias("format")))
    best = F.array_max(F.array(*rows))
    return means.select(*by, F.when(best["confidence"] < 0.35, "GENERIC_TEXT").otherwise(best["format"]).alias("format"), best["confidence"].alias("confidence"))


def parse(df: DataFrame, line: str = "content", parsers: list[ParserSpec] | None = None) -> DataFrame:
    """df (with parser) plus fields, parse_confidence, parsed_event_type and parser_version."""
    return settled(parse_steps(df, line, parsers, settled))


def parse_steps(df: DataFrame, line: str, parsers: list[ParserSpec] | None = None, between: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """parse where no filter follows before the next settled: the optimizer leaves projections apart that name a column of the one before more than once."""
    parsers = parsers or BUILT_IN
    text = F.coalesce(F.col(line), F.lit(""))

    def by_parser(of) -> Column:
        made = None
        for p in parsers:
            if (value := of(p)) is not None:
                made = F.when(F.col("parser") == p.name, value) if made is None else made.when(F.col("parser") == p.name, value)
        return made

    before = lambda p, n: [F.col(f"__made{i}") for i in range(min(n, len(p.prepare)))]
    steps = max(len(p.prepare) for p in parsers)
    for n in range(steps):
        df = between(df.withColumn(f"__made{n}", by_parser(lambda p: p.prepare[n](text, *before(p, n)) if n < len(p.prepare) else None)))  # noqa: B023

    def row(p: ParserSpec) -> Column:
        fields, confidence, event = p.parse(text, *before(p, steps))
        return F.struct(fields.alias("fields"), confidence.cast("double").alias("confidence"), event.alias("event"), F.lit(p.version).alias("version"))

    df = df.withColumn("parsed", by_parser(row))
    known = F.map_filter("parsed.fields", lambda k, v: v.isNotNull())
    named = [known.alias("fields"), F.col("parsed.confidence").alias("parse_confidence"), F.col("parsed.event").alias("parsed_event_type"), F.col("parsed.version").alias("parser_version")]
    return between(df.drop(*[f"__made{i}" for i in range(steps)])).select("*", *named).drop("parsed")
