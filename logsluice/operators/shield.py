"""Log shield: screens lines for injection into the logging chain and for attack payloads, in Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CONTROL, any_of, contains_any

MAX_CHARS = 32 * 1024

# The checks by name, pattern, severity and category, in the order in which they are reported.
CHECKS = [
    ("crlf_injection", r"(?:%0d%0a|%0a%0d|%0a|%0d|\\r\\n).{0,40}(?:\bLOGIN\b|\bAUTH\b|status=|sshd\[|Accepted password|Failed password|[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})", "high", "injection"),
    ("log4shell", r"\$\{jndi:(?:ldap|ldaps|rmi|dns|nis|iiop|corba|nds|http):", "critical", "injection"),
    ("template_injection", r"\$\{(?:env|sys|java|lower|upper|date|main|jndi):", "high", "injection"),
    ("format_string", r"(?:%n){2,}|%\d*\$n", "high", "injection"),
    ("literal_escape_seq", r"\\x1b[\[\]]|\\033[\[\]]|\\e\[|\\u001b", "high", "injection"),
    ("xxe", r"<!ENTITY\b|<!DOCTYPE\b[^>]*\bSYSTEM\b", "high", "injection"),
    ("script_tag", r"<\s*script[\s/>]", "high", "payload"),
    ("event_html", r"on(?:error|load|click|mouseover)\s*=\s*['\"]?", "medium", "payload"),
    ("sql_injection", r"(?i)(?:\bunion\s+select\b|\bor\s+1\s*=\s*1\b|'\s*or\s*'?1'?\s*=\s*'?1|;\s*drop\s+table\b|\bxp_cmdshell\b)", "high", "payload"),
    ("path_traversal", r"(?:\.\./){2,}|(?:\.\.\\){2,}|%2e%2e%2f|/etc/passwd\b", "medium", "payload"),
    ("shell_metachars", r"\$\(|\|\s*(?:sh|bash|nc|curl|wget|python)\b|`[^`]+`", "medium", "payload"),
]
#: Plain texts of which a line that a check matches holds at least one (in lower case where the check ignores case).
NEEDED = {
    "crlf_injection": ("%0", "\\r"), "log4shell": ("${jndi:",), "template_injection": ("${",), "format_string": ("%",), "literal_escape_seq": ("\\",), "xxe": ("<!",),
    "script_tag": ("<",), "event_html": ("=",), "sql_injection": ("union", "xp_cmdshell", "=", ";"), "path_traversal": ("..", "%2e", "/etc/passwd"), "shell_metachars": ("$(", "|", "`"),
}
ESCAPES = r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b\][^\x07]*(?:\x07|\x1b\\)"
INDICATORS = "array<struct<type:string,severity:string,category:string,rank:int,detail:string>>"
_RANK = {"medium": 2, "high": 3, "critical": 4}


def _indicator(kind: str, severity: str, category: str, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(_RANK[severity]).alias("rank"), detail.alias("detail"))


def indicators(line: Column) -> Column:
    """All that the checks find, as an array of (type, severity, category, rank, detail)."""
    bare = F.replace(line, F.lit("\x1b"), F.lit(""))
    codes = F.transform(F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(f"({CONTROL})"), 1))), lambda c: F.concat(F.lit("0x"), F.lower(F.hex(F.encode(c, "UTF-8")))))
    found = [
        (F.char_length(line) > MAX_CHARS, _indicator("oversize_line", "medium", "injection", F.concat(F.char_length(line).cast("string"), F.lit(" chars")))),
        (line.contains("\x1b") & line.rlike(ESCAPES), _indicator("terminal_escape_sequence", "high", "injection", F.lit("escape sequence in log content"))),
        (bare.rlike(CONTROL), _indicator("dangerous_control_chars", "high", "injection", F.array_join(codes, ", "))),
    ]
    for kind, pattern, severity, category in CHECKS:
        snippet = F.left(F.regexp_replace(F.replace(F.regexp_extract(line, pattern, 0), F.lit("\x1b"), F.lit("\\x1b")), CONTROL, "�"), F.lit(120))
        needed = contains_any(F.lower(line) if pattern.startswith("(?i)") else line, *NEEDED[kind])
        found.append((needed & line.rlike(pattern), _indicator(kind, severity, category, snippet)))
    # the filter, and all in it, is interpreted: lines without a finding do not enter it
    some = F.filter(F.array(*[F.when(test, told) for test, told in found]), lambda x: x.isNotNull())
    return F.when(any_of(*[test for test, _ in found]), some).otherwise(F.array().cast(INDICATORS))


def screen(df: DataFrame, line: str = "content", quarantine_injection: bool = True) -> DataFrame:
    """df with indicators, verdict, quarantine and summary. A null line is SAFE."""
    df = df.withColumn("indicators", indicators(F.coalesce(F.col(line), F.lit(""))))
    injection = F.filter("indicators", lambda x: x["category"] == "injection")
    top = F.coalesce(F.array_max(F.transform(injection, lambda x: x["rank"])), F.lit(0))
    some = F.size("indicators") > 0  # looked at first: what is interpreted runs for lines with a finding only
    weapon = some & ((top >= 4) | ((top == 3) & (F.size(injection) >= 2)))
    verdict = F.when(weapon, "WEAPONIZED_LOG").when(some, "SUSPICIOUS").otherwise("SAFE")
    types = F.array_join(F.array_sort(F.array_distinct(F.transform("indicators", lambda x: x["type"]))), ", ")
    return df.select(
        "*",
        verdict.alias("verdict"),
        (weapon | (some & (F.size(injection) > 0) & F.lit(quarantine_injection))).alias("quarantine"),
        F.when(some, F.concat(verdict, F.lit(": "), types)).otherwise("no injection indicators").alias("summary"),
    )


def security_events(screened: DataFrame, source: str = "source_name", at: str = "received_at") -> DataFrame:
    """One row per line that is not SAFE."""
    worst = F.array_max(F.transform("indicators", lambda x: F.struct(x["rank"], x["severity"])))["severity"]
    types = F.array_join(F.array_sort(F.array_distinct(F.transform("indicators", lambda x: x["type"]))), ",")
    return screened.where("verdict <> 'SAFE'").select(
        F.col(at).alias("ts"), F.lit("log_shield").alias("event_type"), types.alias("detection_type"), F.col(source).alias("source"), worst.alias("severity"),
        "verdict", "raw_log_id", "job_id", F.left("summary", F.lit(500)).alias("reason"), "indicators",
    )
