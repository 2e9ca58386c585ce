"""Spellings of timestamps: a table written out by hand, and random ones against a public parser where it is there."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logsluice.functions import columns, times

REFERENCE = "2026-06-30 00:00:00"
SPELLINGS = {
    "2003-09-25 10:49:41": "2003-09-25 10:49:41", "2003-09-25T10:49:41Z": "2003-09-25 10:49:41", "2003-09-25t10:49": "2003-09-25 10:49:00", "2003-09-25T10:49:41.5-03:00": "2003-09-25 13:49:41.5",
    "2003-09-25 10:49:41,502": "2003-09-25 10:49:41.502", "2003-09-25 10:49:41 +05": "2003-09-25 05:49:41", "2003-09-25 10:00 -3": "2003-09-25 13:00:00", "2003-09-25 10:00 +1:30": "2003-09-25 08:30:00",
    "2003-09-25 10:00 GMT+3": "2003-09-25 13:00:00", "2003-09-25 10:00:00.123456789Z": "2003-09-25 10:00:00.123456", "2003-09-25, 10:36": "2003-09-25 10:36:00", "2003-09-25;10:36": "2003-09-25 10:36:00",
    "20030925T104941-0300": "2003-09-25 13:49:41", "20030925T104941": "2003-09-25 10:49:41", "20030925104941": "2003-09-25 10:49:41", "200309251049": "2003-09-25 10:49:00", "20030925": "2003-09-25 00:00:00",
    "2003/9/5": "2003-09-05 00:00:00", "2003.09.25": "2003-09-25 00:00:00", "2003-09": "2003-09-01 00:00:00", "2003": "2003-01-01 00:00:00", "2003 Sep 25": "2003-09-25 00:00:00",
    "03-09-25": "2025-03-09 00:00:00", "99-01-02": "1999-01-02 00:00:00", "25-09-2003": "2003-09-25 00:00:00", "10.09.2003": "2003-10-09 00:00:00", "09/25/2003 10:49": "2003-09-25 10:49:00", "13/09/2003": "2003-09-13 00:00:00",
    "9/25": "2025-09-25 00:00:00", "3/25": "2026-03-25 00:00:00", "Thu Sep 25 10:36:28 2003": "2003-09-25 10:36:28", "Sep 25 10:36:28 UTC 2003": "2003-09-25 10:36:28", "Thu, 25 Sep 2003 10:49:41 -0300": "2003-09-25 13:49:41",
    "Thu, 25 Sep 2003 10:49:41 EST": "2003-09-25 10:49:41", "Sep 25 10:36": "2025-09-25 10:36:00", "Mar  4 06:07:08": "2026-03-04 06:07:08", "Sep 25 10:36:28.123": "2025-09-25 10:36:28.123", "Sep 03": "2025-09-03 00:00:00",
    "Sep 2003": "2003-09-01 00:00:00", "25 Sep 03": "2003-09-25 00:00:00", "25th of September 2003": "2003-09-25 00:00:00", "September 25, 2003 at 10:36 PM": "2003-09-25 22:36:00", "Wed, July 10, '96": "1996-07-10 00:00:00",
    "1996.July.10 AD 12:08 PM": "1996-07-10 12:08:00", "July 10 1996 12:08:33 AM": "1996-07-10 00:08:33", "Sept 5 2003": "2003-09-05 00:00:00", "Mar. 5, 2003": "2003-03-05 00:00:00", "5.Mar.2003": "2003-03-05 00:00:00",
    "5-Mar-2003 7:08 a.m.": "2003-03-05 07:08:00", "10:00:00 2003-09-25": "2003-09-25 10:00:00", "10pm": "2026-01-01 22:00:00", "10 am": "2026-01-01 10:00:00", "12:08": "2026-01-01 12:08:00", "0:01:02": "2026-01-01 00:01:02",
    "10h36m28.5s": "2026-01-01 10:36:28.5", "Sep": "2025-09-01 00:00:00", "2003 10:00": "2003-01-01 10:00:00", "2003-09-25 0am": "2003-09-25 00:00:00", "04/Mar/2026:06:07:08 +0000": "2026-03-04 06:07:08",
    "1064486981": "2003-09-25 10:49:41", "1064486981502": "2003-09-25 10:49:41.502",
    "13-14-2003": None, "2003-09-25 24:00": None, "2003-09-25 10:49:60": None, "Feb 30 2003": None, "31/31/2003": None, "2003-09-25 13pm": None, "2003-09-25 10:61": None, "2003-13-01": None, "yesterday": None, "n/a": None, "": None,
    "2003-09-25 10:00 banana": None, "12 bottles": None, "Mar 32 99:99:99": None, "version 1.2": None, "port 8080": None,
}


def _shown(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", F.expr(f("s")).alias("t"))
    return [None if r["t"] is None else (datetime(1970, 1, 1) + timedelta(microseconds=r["t"])) for r in rows.select("i", F.unix_micros("t").alias("t")).orderBy("i").collect()]


def test_spellings(spark):
    got = dict(zip(SPELLINGS, _shown(spark, SPELLINGS, lambda c: times.timestamp_sql(c, REFERENCE)), strict=True))
    assert len(SPELLINGS) > 60 and {k: v for k, v in got.items() if v != (SPELLINGS[k] and datetime.fromisoformat(SPELLINGS[k]))} == {}


def test_random_spellings_against_a_public_parser(spark):
    parser = pytest.importorskip("dateutil.parser")
    rng = random.Random(12)
    one = rng.choice
    day = lambda t: one([t.strftime("%Y-%m-%d"), t.strftime("%Y/%m/%d"), t.strftime("%d %b %Y"), t.strftime("%b %d, %Y"), t.strftime("%B %d %Y"), t.strftime("%d-%b-%Y"), t.strftime("%m/%d/%Y"), t.strftime("%d.%m.%Y"), t.strftime("%b %d"), t.strftime("%a, %d %b %Y"), t.strftime("%A %B %d, %Y"), t.strftime("%m-%d-%y"), t.strftime("%Y%m%d")])
    clock = lambda t: one([t.strftime("%H:%M:%S"), t.strftime("%H:%M"), t.strftime("%I:%M %p"), t.strftime("%I:%M:%S%p").lower(), t.strftime("%H:%M:%S.%f"), t.strftime("%H:%M:%S") + ",25", t.strftime("%I %p"), "61:00", "23:60"])
    zone = lambda: one(["", "", "", "Z", " UTC", " +0200", "-03:30", " EST", " GMT", " GMT+2", "+01", " CEST"])
    texts = []
    for _ in range(1500):
        t = datetime(1980, 1, 1) + timedelta(seconds=rng.randrange(46 * 365 * 86400))
        d, c = day(t), clock(t)
        z = zone() if c[-1].isdigit() else one(["", " UTC", "-03:30"])
        texts.append(one([f"{d} {c}{z}", f"{d} {c}{z}", f"{c}{z} {d}", d, f"{d}, {c}", f"  {d}   {c}"]))
    want = []
    now = datetime.fromisoformat(REFERENCE).replace(tzinfo=UTC)
    import re
    import warnings

    warnings.simplefilter("ignore")
    for s in texts:
        try:
            t = parser.parse(s.strip(), default=datetime(2026, 1, 1, tzinfo=UTC))
            t = t if t.tzinfo else t.replace(tzinfo=UTC)
            if not re.search(r"\b\d{4}\b", s) and t > now + timedelta(days=2):
                t = t.replace(year=t.year - 1)
            want.append(t.astimezone(UTC).replace(tzinfo=None))
        except (ValueError, OverflowError):
            want.append(None)
    got = _shown(spark, texts, lambda c: times.liberal_sql(f"regexp_replace(trim({c}), ' +', ' ')", REFERENCE))
    wrong = [(s, str(g), str(w)) for s, g, w in zip(texts, got, want, strict=True) if g != w]
    assert not wrong, (len(wrong), wrong[:20])


def test_one_spelling_of_addresses(spark):
    import ipaddress

    rng = random.Random(2)
    texts = ["::", "::1", "1::", "2001:DB8::0:1", "2001:db8:0:0:1:0:0:1", "0:0:0:0:0:0:0:0", "1:0:0:2:0:0:0:3", "fe80::0001:0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "192.0.2.7"]
    texts += [":".join(one) for one in ([rng.choice(["0", "0000", "1", "0a", "FFFF"]) for _ in range(8)] for _ in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", columns.canonical_ip(F.col("s")).alias("c"), columns.valid_ip(F.col("s")).alias("v"))
    for r in df.collect():
        address = ipaddress.ip_address(texts[r["i"]])
        if not getattr(address, "ipv4_mapped", None):  # which some versions of the library write with dots
            assert r["v"] and r["c"] == str(address), texts[r["i"]]
