"""Scalar functions as Column expressions.

Spark interprets a function with a lambda and all that it is applied to, and shares nothing within it: an expression that is named twice there runs twice.
What costs something is therefore bound with `let` before it is named more than once."""

from __future__ import annotations

import hashlib
import hmac as python_hmac
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import let

IPV4 = r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV6 = (
    r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4})"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,5}(?::[0-9A-Fa-f]{1,4}){1,2}|(?:[0-9A-Fa-f]{1,4}:){1,4}(?::[0-9A-Fa-f]{1,4}){1,3}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,3}(?::[0-9A-Fa-f]{1,4}){1,4}|(?:[0-9A-Fa-f]{1,4}:){1,2}(?::[0-9A-Fa-f]{1,4}){1,5}"
    r"|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){1,6}|:(?::[0-9A-Fa-f]{1,4}){1,7}|::"
)
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def empty_to_null(c: Column) -> Column:
    """c, null where it is empty. c is named once."""
    return F.get(F.array_remove(F.array(c), ""), F.lit(0))


#: Noncharacters, which no text interchange holds: they stand before groups, between and after them, and between a name and its group.
_OPEN, _NEXT, _OF = "\ufdd0", "\ufdd1", "\ufdd2"


def any_of(*conditions: Column) -> Column:
    """Whether any condition holds; those after the first that does are not evaluated."""
    return reduce(or_, conditions)


def all_of(*conditions: Column) -> Column:
    """Whether all conditions hold; those after the first that does not are not evaluated."""
    return reduce(and_, conditions)


def contains_any(c: Column, *texts: str) -> Column:
    """Whether c holds one of some plain texts: what a pattern needs anyway, and cheaper to find."""
    return any_of(*[c.contains(t) for t in texts])


def capture(c: Column, pattern: str, names: Iterable[str]) -> dict[str, Column]:
    """The capturing groups of the first match by name, null where a group is missing or empty. Groups are positional
    (names with underscores are not legal in Java patterns). A pattern that starts at the line's start is matched once for all
    its groups."""
    names = list(names)
    if not pattern.startswith("^"):
        pieces = lambda i: F.regexp_extract(c, pattern, i + 1)
    else:
        at = groups(c, pattern, len(names))
        pieces = lambda i: F.get(at, F.lit(i))
    return {name: empty_to_null(pieces(i)) for i, name in enumerate(names)}


def groups(c: Column, pattern: str, n: int) -> Column:
    """The n capturing groups of a pattern that starts at the line's start, as an array (a missing group is empty); null where it does not match."""
    marked = F.regexp_replace(c, pattern, _OPEN + _NEXT.join(f"${i + 1}" for i in range(n)) + _NEXT)
    # what follows the mark is null where there is none
    split = F.split(F.get(F.array_remove(F.array(F.regexp_extract(marked, f"^{_OPEN}([\\s\\S]*)$", 1)), ""), F.lit(0)), _NEXT)
    return F.when(_holds_marks(c), F.when(c.rlike(pattern), F.array(*[F.regexp_extract(c, pattern, i + 1) for i in range(n)]))).otherwise(split)


def _holds_marks(c: Column) -> Column:
    """Whether a text holds a mark itself: its groups are read one by one, as marks would move them."""
    return contains_any(c, _OPEN, _NEXT, _OF)


def captured(c: Column, pattern: str, names: Iterable[str]) -> Column:
    """capture as a map of the groups that are there, by one match of a pattern that starts at the line's start. The match is written as names and groups, which are
    read as a map; a line that holds a mark goes by its groups, one by one."""
    names = list(names)
    marked = F.regexp_replace(c, pattern, _OPEN + "".join(f"{name}{_OF}${i + 1}{_NEXT}" for i, name in enumerate(names)))
    # a line that does not match has no mark and is read as a name without a group, which the filter drops
    read = F.str_to_map(F.substring_index(F.substring_index(marked, _OPEN, -1), _NEXT, len(names)), F.lit(_NEXT), F.lit(_OF))

    def made(at: Column) -> Column:
        entries = F.array(*[F.struct(F.lit(name).alias("key"), F.get(at, F.lit(i)).alias("value")) for i, name in enumerate(names)])
        return F.map_from_entries(F.filter(entries, lambda e: e["value"] != ""))

    return F.when(_holds_marks(c), let(groups(c, pattern, len(names)), made)).otherwise(F.map_filter(read, lambda k, v: v != ""))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """c mapped through a literal table, null for other values. The table is one text, so that it costs the driver one call. A map is searched from end
    to end: there is one for each length of a key, and c is looked for among the keys of its own length."""
    listed = lambda xs: "split('" + "\x1f".join(xs) + "', '\x1f')"
    by_length = [{k: v for k, v in table.items() if len(k) == n} for n in range(max(map(len, table)) + 1)]
    maps = ", ".join(f"map_from_arrays({listed(t)}, {listed(t.values())})" if t else "map('\x1f\x1f', '')" for t in by_length)
    return let(F.coalesce(c, F.lit("")), lambda k: F.try_element_at(F.get(F.expr(f"array({maps})"), F.char_length(k)), k))


def to_int(c: Column) -> Column:
    """The integer that a text writes, else null."""
    return F.when(F.trim(c).rlike(r"^[+-]?[0-9]{1,9}$"), F.trim(c).cast("int"))


def valid_ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^{IPV4}$"), F.lit(False))


def valid_ip(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^(?:{IPV4}|{IPV6})$"), F.lit(False))


def canonical_ip(c: Column) -> Column:
    """A valid address in its one spelling: IPv6 in lower case, without leading zeros, its first longest run of two zero groups or more as ::."""

    def six(x: Column) -> Column:
        halves = F.split(F.lower(x), "::")
        groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
        return let(F.struct(groups(0).alias("a"), groups(1).alias("b")), whole)

    def whole(h: Column) -> Column:
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(h["a"]) - F.size(h["b"]), F.lit(0)))
        return let(F.transform(F.concat(h["a"], zeros, h["b"]), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), shortened)

    def shortened(g: Column) -> Column:
        marks = F.array_join(F.transform(g, lambda x: F.when(x == "0", "0").otherwise("x")), "")
        out = F.array_join(g, ":")
        for n in range(2, 9):  # the longest run is tried last and stands
            at = F.instr(marks, "0" * n)
            cut = F.concat(F.array_join(F.slice(g, F.lit(1), F.greatest(at - 1, F.lit(0))), ":"), F.lit("::"), F.array_join(F.slice(g, at + n, F.lit(8)), ":"))
            out = F.when(at > 0, cut).otherwise(out)
        return out

    return F.when(c.contains(":"), let(F.trim(c), six)).otherwise(F.trim(c))


def valid_port(c: Column) -> Column:
    return F.coalesce(to_int(c).between(0, 65535), F.lit(False))


def _pad(key: str, byte: int) -> bytes:
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(x ^ byte for x in raw)


def hmac_sha256(key: str, message: Column) -> Column:
    """Hex HMAC-SHA256 of a text under a fixed key."""
    inner = F.sha2(F.concat(F.lit(_pad(key, 0x36)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(_pad(key, 0x5C)), F.unhex(inner)), 256)


def hmac_of(key: str, message: str) -> str:
    return python_hmac.new(key.encode(), message.encode(), hashlib.sha256).hexdigest()
