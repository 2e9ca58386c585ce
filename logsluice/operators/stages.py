"""What each stage of the record pipeline said about each line, and counts of it from the same pass.

A line that is blank or a duplicate enters no stage; one that the shield stops has only that stage. Every other line has all stages, each with a status
(ok, warn, error or skipped) and its messages; nothing that a line holds fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import to_int
from . import normalize as N

# The stages in order, and what they say.
STAGES = ["security_shield", "format_detection", "parsing", "cleaning", "field_extraction", "pii_obfuscation", "normalization", "validation"]
STATUSES = ["ok", "warn", "error", "skipped"]
LOW_CONFIDENCE, NO_PARSER = "low-confidence format detection", "no structured parser matched; raw fallback used"
BAD_VALUE = {"not a parseable timestamp": N.TIME_FIELDS, "not a valid IP address": N.IP_FIELDS, "not a valid port": N.PORT_FIELDS, "not a numeric status code": N.CODE_FIELDS}

_NONE = F.array().cast("array<string>")
RESULT = "array<struct<stage:string,status:string,messages:array<string>>>"


def _one(stage: str, status: Column, messages: Column = _NONE) -> Column:
    return F.struct(F.lit(stage).alias("stage"), status.alias("status"), messages.alias("messages"))


def _when(condition: Column, text: Column) -> Column:
    return F.when(condition, F.array(text)).otherwise(_NONE)


def _rejected() -> Column:
    """What cleaning found in fields that it renamed to <field>_raw, by name."""
    fields = F.filter(F.map_entries("fields"), lambda e: e["key"].endswith("_raw"))

    def said(e: Column) -> Column:
        name = F.regexp_replace(e["key"], "_raw$", "")
        low, out = F.lower(name), F.lit(None).cast("string")
        for text, names in reversed(BAD_VALUE.items()):
            out = F.when(low.isin(*names), F.concat(name, F.lit(": '"), e["value"], F.lit(f"' is {text}"))).otherwise(out)
        return out

    return F.array_sort(F.filter(F.transform(fields, said), lambda x: x.isNotNull()))


def _dropped() -> Column:
    """What normalisation found in number fields: their last value by any name that is no number."""
    entries = F.map_entries("fields")

    def one(c: str) -> Column:
        names = [n for n in (*N.FIELD_NAMES[c], c)]
        value = F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]).isin(*names)), F.lit(-1))["value"]
        return F.when(to_int(value).isNull() & value.isNotNull(), F.concat(F.lit(f"{c}: '"), value, F.lit("' is not an integer, dropped")))

    return F.filter(F.array(*[one(c) for c in N.NUMBERS]), lambda x: x.isNotNull())


def _invalid() -> Column:
    """Why an event is not valid: values outside a range or vocabulary."""
    found = [F.when(F.col(c) > top, F.concat(F.lit(f"{c}: "), F.col(c).cast("string"), F.lit(f" is above {top}"))) for c, top in (("source_port", 65535), ("destination_port", 65535), ("response_code", 599))]
    found += [F.when(F.col(c) < 0, F.concat(F.lit(f"{c}: "), F.col(c).cast("string"), F.lit(" is below 0"))) for c in N.NUMBERS]
    found.append(F.when(~F.col("severity").isin(*N.LEVELS), F.concat(F.lit("severity: '"), "severity", F.lit("' is no level"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def reported(done: DataFrame) -> DataFrame:
    """Processed lines (pipeline.processed) with stages: what each stage that ran said."""
    col = F.col
    entered = (F.trim(F.coalesce(col("content"), F.lit(""))) != "") & ~col("duplicate")
    shield = _one("security_shield", F.when(col("verdict") == "WEAPONIZED_LOG", "error").when(col("verdict") == "SUSPICIOUS", "warn").otherwise("ok"), _when(col("verdict") != "SAFE", col("summary")))
    low, raw = col("format_confidence") < 0.35, col("parser") == "raw"
    warned = lambda m: F.when(F.size(m) > 0, "warn").otherwise("ok")
    rest = F.array(
        _one("format_detection", F.when(low, "warn").otherwise("ok"), _when(low, F.lit(LOW_CONFIDENCE))), _one("parsing", F.when(raw, "warn").otherwise("ok"), _when(raw, F.lit(NO_PARSER))),
        _one("cleaning", warned(_rejected()), _rejected()), _one("field_extraction", F.lit("ok")), _one("pii_obfuscation", F.when(col("pii_mode") == "OFF", "skipped").otherwise("ok")),
        _one("normalization", warned(_dropped()), _dropped()),
        _one("validation", F.when(~col("valid"), "error").when(col("processing_status") == "partial", "warn").otherwise("ok"), F.transform(_invalid(), lambda x: F.concat(F.lit("schema validation failed: "), x))),
    )
    return done.withColumn("stages", F.when(~entered, F.array().cast(RESULT)).when(col("quarantine"), F.array(shield)).otherwise(F.concat(F.array(shield), rest)))


def problems(reported: DataFrame, *keep: str) -> DataFrame:
    """One row per message: the columns `keep`, stage, status, message."""
    rows = reported.select(*keep, F.explode("stages").alias("s")).select(*keep, "s.stage", "s.status", F.explode("s.messages").alias("message"))
    return rows


def _count(stage: str, status: str) -> Column:
    return F.count_if(F.exists("stages", lambda s: (s["stage"] == stage) & (s["status"] == status)))


def counted(reported: DataFrame) -> DataFrame:
    """Lines by stage and status: stage, status, n."""
    return reported.select(F.explode("stages").alias("s")).groupBy("s.stage", "s.status").agg(F.count("*").alias("n"))


def observed(reported: DataFrame, name: str = "stages") -> tuple[DataFrame, Observation]:
    """The same lines, and an observation that has, once they were written, the number of lines, of each disposition and of each stage and status:
    the job's summary without a second pass."""
    watch = Observation(name)
    kinds = [F.count_if(F.col("disposition") == d).alias(d) for d in ("PROCESSED", "INVALID", "DUPLICATE", "QUARANTINED")]
    each = [_count(stage, status).alias(f"{stage}.{status}") for stage in STAGES for status in STATUSES]
    return reported.observe(watch, F.count("*").alias("total"), *kinds, *each), watch


def job_row(watch: Observation, job: str) -> tuple:
    """(job, total, processed, invalid, duplicate, quarantined, {stage: {status: n}}) from an observation of a finished write."""
    got = watch.get
    stages = {stage: {s: got[f"{stage}.{s}"] for s in STATUSES if got[f"{stage}.{s}"]} for stage in STAGES}
    return (job, got["total"], got["PROCESSED"], got["INVALID"], got["DUPLICATE"], got["QUARANTINED"], stages)
