"""Reading of timestamps: the usual spellings by a pattern each, others liberally, where the text is cut into a time with its zone and a date, and each is
read by rules of order.

The expressions are SQL texts: as Columns they would cost the driver thousands of calls for every plan that reads a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names by their first three letters, in order; weekday names and the words and endings of numbers that say nothing.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DAYS = r"(?i)\b(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\b\.?"
_WORDS = r"(?i)\b(?:at|on|of|and|ad)\b|(?<=[0-9])(?:st|nd|rd|th)\b"

_HALF = r"(?: ?([AaPp])\.?[Mm]\b\.?)"
_NAME = r"(?!(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))[A-Z]{3,5}"
#: A zone: a name alone says nothing but for UTC, a name before a signed number turns its sign.
_ZONE = rf"(?: ?(?:({_NAME})?([+-])([0-9]{{1,2}}):?([0-9]{{2}})?|[Zz]|{_NAME})(?![0-9A-Za-z:]))?"
_TIME = rf"(?<![0-9:.+-])([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}})(?:[.,]([0-9]{{1,9}}))?)?(?![0-9:]){_HALF}?{_ZONE}"
_HOUR = rf"(?<![0-9:.])([0-9]{{1,2}}){_HALF}{_ZONE}"
#: A year of four digits anywhere in the text.
WHOLE_YEAR = r"\b[0-9]{4}\b"
_PART = r"(?: ?[-/.] ?| )"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value worked out once however often `of` names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _re(pattern: str) -> str:
    return f'r"{pattern}"'


def _group(text: str, pattern: str, i: int) -> str:
    return f"nullif(regexp_extract({text}, {_re(pattern)}, {i}), '')" if i else "CAST(NULL AS STRING)"


def _replaced(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, new in steps:
        text = f"regexp_replace({text}, {_re(pattern)}, '{new}')"
    return text


#: Words that say nothing go, and compact or spelled times are written with colons.
_SHORTER = [
    (_DAYS, " "), (_WORDS, " "), (r",(?= |$)|;|(?<!:[0-9]{2}),", " "), (r"([0-9])[Tt]([0-9])", "$1 $2"),
    (r"^ *([0-9]{4})([0-9]{2})([0-9]{2}) ?([0-9]{2})([0-9]{2})([0-9]{2})(?![0-9:])", "$1-$2-$3 $4:$5:$6"),
    (r"^ *([0-9]{4})([0-9]{2})([0-9]{2}) ?([0-9]{2})([0-9]{2})(?![0-9:])", "$1-$2-$3 $4:$5"),
    (r"^ *([0-9]{4})([0-9]{2})([0-9]{2})(?![0-9])", "$1-$2-$3"),
    (r"(?i)\b([0-9]{1,2}) ?h ?([0-9]{2}) ?m ?([0-9]{2})(\.[0-9]+)? ?s\b", "$1:$2:$3$4"), (r"(?i)\b([0-9]{1,2}) ?h ?([0-9]{2}) ?m\b", "$1:$2"), (r" +", " "),
]

#: Dates: pattern, and which groups are year, month and day.
_DATES = [
    (r"^$", 0, 0, 0), (rf"^([0-9]{{4}}){_PART}([0-9]{{1,2}}){_PART}([0-9]{{1,2}})$", 1, 2, 3), (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", 1, 2, 3), (r"^([0-9]{4})[-/.]([0-9]{1,2})$", 1, 2, 0),
    (rf"(?i)^([0-9]{{4}}){_PART}{_MONTH}\.?(?:{_PART}([0-9]{{1,2}}))?$", 1, 2, 3), (rf"(?i)^([0-9]{{1,2}}){_PART}?{_MONTH}\.?(?:{_PART}'?([0-9]{{4}}|[0-9]{{2}}))?$", 3, 2, 1),
    (rf"(?i)^{_MONTH}\.?{_PART}?([0-9]{{1,2}})(?:{_PART}'?([0-9]{{4}}|[0-9]{{2}}))?$", 3, 1, 2), (rf"(?i)^{_MONTH}\.?{_PART}([0-9]{{4}})$", 2, 1, 0), (rf"(?i)^{_MONTH}$", 0, 1, 0), (r"^([0-9]{4})$", 1, 0, 0),
]
_NUMBERS, _TWO = rf"^([0-9]{{1,2}}){_PART}([0-9]{{1,2}}){_PART}'?([0-9]{{4}}|[0-9]{{2}})$", r"^([0-9]{1,2})[-/]([0-9]{1,2})$"


def _date(d: str) -> str:
    """struct(y, m, d) of texts from a date without its time; what is not named is null. Null if it is no date."""
    made = lambda pattern, y, m, day: f"named_struct('y', {_group(d, pattern, y)}, 'm', {_group(d, pattern, m)}, 'd', {_group(d, pattern, day)})"
    first = lambda pattern: f"CAST(regexp_extract({d}, {_re(pattern)}, 1) AS INT)"
    cases = [f"WHEN {d} rlike {_re(p)} THEN {made(p, *at)}" for p, *at in _DATES]
    # numbers alone: the month first where it can be one, the year where it must be
    cases.append(f"WHEN {d} rlike {_re(_NUMBERS)} THEN CASE WHEN {first(_NUMBERS)} > 31 THEN {made(_NUMBERS, 1, 2, 3)} WHEN {first(_NUMBERS)} > 12 THEN {made(_NUMBERS, 3, 2, 1)} ELSE {made(_NUMBERS, 3, 1, 2)} END")
    cases.append(f"WHEN {d} rlike {_re(_TWO)} THEN CASE WHEN {first(_TWO)} > 12 THEN {made(_TWO, 0, 2, 1)} ELSE {made(_TWO, 0, 1, 2)} END")
    return f"CASE {' '.join(cases)} END"


def _moment(x: str, y: str) -> str:
    month = f"CASE WHEN {x}.dt.m rlike '^[0-9]' THEN CAST({x}.dt.m AS INT) ELSE CAST(array_position(array({', '.join(repr(m) for m in MONTHS)}), lower(left({x}.dt.m, 3))) AS INT) END"
    hour = f"coalesce(CAST({x}.h AS INT), 0)"
    half = f"CASE WHEN lower({x}.ap) = 'p' THEN CASE WHEN {hour} < 12 THEN {hour} + 12 ELSE {hour} END WHEN {hour} = 12 THEN 0 ELSE {hour} END"
    hours = f"CASE WHEN {x}.ap IS NULL THEN {hour} WHEN {hour} <= 12 THEN {half} END"
    seconds = f"CAST(concat(coalesce({x}.s, '0'), '.', rpad(left(coalesce({x}.f, '0'), 6), 6, '0')) AS DECIMAL(16, 6))"
    at = f"try_make_timestamp({y}, coalesce({month}, 1), coalesce(CAST({x}.dt.d AS INT), 1), {hours}, coalesce(CAST({x}.mi AS INT), 0), CASE WHEN {seconds} < 60 THEN {seconds} END, 'UTC')"
    ahead = f"CASE WHEN ({x}.sg = '+') = ({x}.zn IS NULL) THEN 1 ELSE -1 END * (CAST({x}.zh AS INT) * 60 + coalesce(CAST({x}.zm AS INT), 0))"
    return f"CASE WHEN {x}.sg IS NULL THEN {at} ELSE timestamp_micros(unix_micros({at}) - CAST({ahead} AS BIGINT) * 60000000) END"


def liberal_sql(s: str, reference: str) -> str:
    """The timestamp (UTC where no zone is named) that a text writes: dates with the year, a month name or numbers in front (the month first where it can be one),
    years of two digits within 50 years of the reference, 12-hour and compact times, fractions, zones as offsets; null for other texts. What is not named is the
    reference's year, January, the first, midnight; a text without a year of four digits that lies more than two days after the reference is of the year before.
    s: SQL of a text whose white space is single spaces."""
    year = int(reference[:4])
    short = f"CAST(x.dt.y AS INT) + {year // 100 * 100}"
    y = f"CASE WHEN x.dt.y IS NULL THEN {year} WHEN length(x.dt.y) = 4 THEN CAST(x.dt.y AS INT) WHEN {short} >= {year + 50} THEN {short} - 100 WHEN {short} < {year - 50} THEN {short} + 100 ELSE {short} END"
    placed = _let(f"named_struct('at', {_moment('x', y)}, 'y', {y})", "r", f"CASE WHEN NOT x.fy AND r.at > TIMESTAMP '{reference}' + INTERVAL 2 DAYS THEN {_moment('x', '(r.y - 1)')} ELSE r.at END")

    def cut(pattern: str, groups: dict[str, int], timed: bool) -> str:
        rest = f"regexp_replace(t.text, {_re(pattern)}, ' ')" if timed else "t.text"
        rest = f"regexp_replace(trim(regexp_replace({rest}, ' +', ' ')), {_re(r'^[-/., ]+|[-/., ]+$')}, '')"
        fields = ", ".join(f"'{n}', {_group('t.text', pattern, groups.get(n, 0))}" for n in ("h", "mi", "s", "f", "ap", "zn", "sg", "zh", "zm"))
        date = _let(rest, "d", _date("d") if timed else f"CASE WHEN d <> '' THEN {_date('d')} END")
        return _let(f"named_struct('dt', {date}, 'fy', t.fy, {fields})", "x", f"CASE WHEN x.dt IS NOT NULL THEN {placed} END")

    clock = {"h": 1, "mi": 2, "s": 3, "f": 4, "ap": 5, "zn": 6, "sg": 7, "zh": 8, "zm": 9}
    hours = {"h": 1, "ap": 2, "zn": 3, "sg": 4, "zh": 5, "zm": 6}
    read = f"CASE WHEN t.text rlike {_re(_TIME)} THEN {cut(_TIME, clock, True)} WHEN t.text rlike {_re(_HOUR)} THEN {cut(_HOUR, hours, True)} ELSE {cut('$^', {}, False)} END"
    some = _re(rf"[0-9]|(?i)^(?:{'|'.join(MONTHS)})")
    text = f"named_struct('text', trim({_replaced(s, _SHORTER)}), 'fy', {s} rlike {_re(WHOLE_YEAR)})"
    return f"CASE WHEN length({s}) <= 64 AND {s} rlike {some} THEN {_let(text, 't', read)} END"


def timestamp_sql(c: str, reference: str) -> str:
    """The timestamp that a text (SQL) writes: epoch seconds or milliseconds, ISO 8601, BSD syslog (no year: the year of `reference`, or the year before where
    that lies more than two days after it), access log and HAProxy by a pattern each; other texts are read liberally."""
    iso = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?)?( ?(Z|UTC|[+-][0-9]{2}:?[0-9]{2}))?$"
    plain = _replaced("s", [(",", "."), (r" ?(UTC|Z)$", "Z"), (r" ?([+-][0-9]{2}):?([0-9]{2})$", "$1:$2")])
    late = f"CASE WHEN b > TIMESTAMP '{reference}' + INTERVAL 2 DAYS THEN CAST(add_months(b, -12) AS TIMESTAMP) + (b - date_trunc('DAY', b)) ELSE b END"
    usual = [
        (r"^[0-9]{10}([.][0-9]*)?$", "timestamp_micros(CAST(CAST(s AS DOUBLE) * 1000000 AS BIGINT))"), (r"^[0-9]{13}$", "timestamp_millis(CAST(s AS BIGINT))"), (iso, f"try_to_timestamp({plain})"),
        (r"^[A-Z][a-z]{2} [0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}$", _let(f"try_to_timestamp(concat('{reference[:4]} ', s), 'yyyy MMM d HH:mm:ss')", "b", late)),
        (r"^[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9:]{8} [+-][0-9]{4}$", "try_to_timestamp(s, 'dd/MMM/yyyy:HH:mm:ss xx')"),
        (r"^[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9:]{8}[.][0-9]{3}$", "try_to_timestamp(s, 'dd/MMM/yyyy:HH:mm:ss.SSS')"),
    ]
    cases = " ".join(f"WHEN s rlike {_re(p)} THEN {made}" for p, made in usual)
    return _let(_replaced(f"trim({c})", [(r"\s+", " ")]), "s", f"CASE {cases} ELSE {liberal_sql('s', reference)} END")


_ISO_PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?Z?$"
_BSD = r"^[A-Z][a-z]{2} [0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"
_ACCESS = r"^[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9:]{8} [+-][0-9]{4}$"


def common_sql(c: str, reference: str) -> tuple[str, str]:
    """timestamp_sql for the commonest spellings in generated code, which it shares with no lambda: the SQL of a time, whose year is open for BSD syslog, and
    the SQL that closes it, given the first as column `__moment`. Null for other texts, whether or not they write a time. c: SQL of a text whose white space is single spaces."""
    first = f"""CASE WHEN {c} rlike {_re(_BSD)} THEN try_to_timestamp(concat('{reference[:4]} ', {c}), 'yyyy MMM d HH:mm:ss')
        WHEN {c} rlike {_re(_ISO_PLAIN)} THEN try_to_timestamp({c}) WHEN {c} rlike {_re(_ACCESS)} THEN try_to_timestamp({c}, 'dd/MMM/yyyy:HH:mm:ss xx') END"""
    closed = f"CASE WHEN __moment > TIMESTAMP '{reference}' + INTERVAL 2 DAYS AND {c} rlike {_re(_BSD)} THEN CAST(add_months(__moment, -12) AS TIMESTAMP) + (__moment - date_trunc('DAY', __moment)) ELSE __moment END"
    return first, closed


def parse_timestamp(column: str, reference: str) -> Column:
    """timestamp_sql of a column."""
    return F.expr(timestamp_sql(f"`{column}`", reference))
