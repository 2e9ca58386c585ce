"""Template mining, lossless payloads and their accounting.

Lines are cut into tokens and separators; positions of lines with equally many tokens are literal or variable by what values they take; lines
with the same literals share a template. Counts per position are aggregated before anything is compared, and the mask of a token count is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.store import ranked, settled, stored

# Token classes in order, and those that vary by nature.
CLASSES = [
    ("quoted", r"^\"[^\"]*\"$|^'[^']*'$"),
    ("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
    ("mac", r"^(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$"),
    ("ipv4", r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?::\d{1,5})?$"),
    ("timestamp", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+\-]\d{2}:?\d{2})?$|^\d{2}:\d{2}:\d{2}(?:\.\d+)?$|^\[\d+\.\d+\]$"),
    ("email", r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"),
    ("url", r"^https?://\S+$"),
    ("number", r"^[+-]?\d+(?:\.\d+)?%?$"),
    ("ipv6", r"^(?=.*::)(?=.*[0-9a-fA-F].*:.*[0-9a-fA-F])[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4})+$|^[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){3,}$"),
    ("hash", r"^[0-9a-fA-F]{32,}$|^(?=.*[a-fA-F])[0-9a-fA-F]{8,}$"),
]
VARYING = ("ipv4", "ipv6", "uuid", "mac", "timestamp", "hash", "email", "url")
DOMINANT = 0.5


#: What a token of a class has at least; the pattern is tried only then.
_CHEAP = {
    "quoted": lambda t: t.endswith('"') | t.endswith("'"), "uuid": lambda t: F.length(t) == 36, "mac": lambda t: F.length(t) == 17, "ipv4": lambda t: t.contains("."),
    "timestamp": lambda t: t.contains(":") | t.startswith("["), "email": lambda t: t.contains("@"), "url": lambda t: t.startswith("http"), "number": lambda t: F.lit(True),
    "ipv6": lambda t: t.contains(":"), "hash": lambda t: F.length(t) >= 8,
}


def token_class(token: Column) -> Column:
    """The class of a token, null for plain ones."""
    out = None
    for name, pattern in CLASSES:
        fits = _CHEAP[name](token) & token.rlike(pattern)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def tokenised(df: DataFrame, line: str = "content") -> DataFrame:
    """df with tokens, n_tokens, separators (before each token) and trailing; blank lines are left out."""
    df = df.withColumn("tokens", F.regexp_extract_all(F.coalesce(F.col(line), F.lit("")), F.lit(r"(\S+)"), 1)).where(F.size("tokens") > 0)
    gaps = F.split(F.col(line), r"\S+")
    return df.select("*", F.size("tokens").alias("n_tokens"), F.slice(gaps, 1, F.size("tokens")).alias("separators"), F.element_at(gaps, -1).alias("trailing"))


def anchor_masks(tok: DataFrame) -> DataFrame:
    """(n_tokens, mask): per token count, which positions are literal."""
    pos = tok.select("n_tokens", F.posexplode("tokens").alias("pos", "token"))
    values = pos.groupBy("n_tokens", "pos", "token").agg(F.count("*").alias("c"))
    varying = F.sum(F.when(token_class(F.col("token")).isin(*VARYING), F.col("c")).otherwise(0))
    at = values.groupBy("n_tokens", "pos").agg(F.sum("c").alias("n"), F.count("*").alias("distinct"), F.max("c").alias("top"), varying.alias("varying"))
    literal = ~(F.col("varying") >= F.greatest(F.lit(1.0), F.col("n") * 0.5)) & ((F.col("distinct") == 1) | (F.col("top") / F.col("n") >= DOMINANT))
    return at.groupBy("n_tokens").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", literal.alias("literal")))), lambda x: x["literal"]).alias("mask"))


def matched(df: DataFrame, line: str = "content", key: str = "event_id", source: str = "source") -> DataFrame:
    """Lines with n_tokens, literals (null at variables), variables, their kinds, separators and trailing, and shape: a 64-bit digest of the literals.
    Stored, as masks and templates are taken from the same lines."""
    return masked(stored(tokenised(df.select(F.col(key).alias("id"), F.col(line).alias("line"), F.col(source).alias("source")), "line"), "template-lines"))


def masked(tok: DataFrame) -> DataFrame:
    """Tokenised lines (id, line, source and what tokenised adds) split at the literals that these lines have in common."""
    # masks come out of their sum in parts by n_tokens, by which a join would read all lines of a length in one task; by an expression both sides are
    # dealt out for the join, which adaptive execution then splits or broadcasts
    masks = anchor_masks(tok).select((-F.col("n_tokens")).alias("minus"), "mask")
    out = tok.join(masks, F.col("n_tokens") == -F.col("minus")).drop("minus")
    literals = F.zip_with("tokens", "mask", lambda t, m: F.when(m, t))
    variables = F.transform(F.filter(F.arrays_zip("tokens", "mask"), lambda x: ~x["mask"]), lambda x: x["tokens"])
    out = settled(out.select("id", "line", "source", "n_tokens", "separators", "trailing", literals.alias("literals"), variables.alias("variables")))
    kinds = F.transform("variables", lambda t: F.coalesce(token_class(t), F.lit("value")))
    return out.select("*", kinds.alias("kinds"), F.xxhash64("n_tokens", "literals").alias("shape"))


def templates_of(lines: DataFrame) -> DataFrame:
    """One row per template of matched lines: template_key, pattern, n_tokens, literals, types, signature, occurrences, variable_count, sources,
    first_id, last_id, separators, trailing, shape. Types widen to "value" where lines disagree; keys follow the first line of each template."""
    where = ["shape", "n_tokens", "literals"]
    # one row per template and kinds of variables; what follows runs over these few
    alike = lines.groupBy(*where, "kinds").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "separators", "trailing")).alias("first"), F.max("id").alias("last_id"), F.collect_set("source").alias("sources"))
    heads = alike.groupBy(*where).agg(
        F.sum("n").alias("occurrences"), F.min("first").alias("first"), F.max("last_id").alias("last_id"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.collect_set("kinds").alias("ways"),
    )
    # ways holds one entry for each combination of classes that occurs, however many lines there are
    widened = F.transform(F.element_at("ways", 1), lambda k, i: F.when(F.forall("ways", lambda w: F.get(w, i) == k), k).otherwise("value"))
    heads = heads.withColumn("widened", widened).withColumn("variable_count", F.size("widened"))
    types = F.transform("literals", lambda t, i: F.when(t.isNull(), F.get("widened", F.size(F.filter(F.slice("literals", 1, i + 1), lambda x: x.isNull())) - 1)))
    heads = heads.withColumn("types", types)
    parts = F.zip_with("first.separators", "literals", lambda s, t: F.concat(s, F.coalesce(t, F.lit("<*>"))))
    shape = F.zip_with("literals", "types", lambda t, k: F.coalesce(t, F.concat(F.lit("<"), k, F.lit(">"))))
    found = heads.select(
        F.trim(F.concat(F.array_join(parts, ""), "first.trailing")).alias("pattern"), "n_tokens", "literals", "types",
        F.left(F.sha2(F.concat(F.col("n_tokens").cast("string"), F.lit("|"), F.array_join(shape, "\x1f")), 256), F.lit(32)).alias("signature"),
        "occurrences", "variable_count", "sources", F.col("first.id").alias("first_id"), "last_id", F.col("first.separators").alias("separators"), F.col("first.trailing").alias("trailing"), "shape",
    )
    return ranked(found, "first_id").withColumn("template_key", _key(F.col("nth"))).drop("nth")


def _key(nth: Column) -> Column:
    digits = nth.cast("string")
    return F.concat(F.lit("TPL-"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def mine(df: DataFrame, line: str = "content", key: str = "event_id", source: str = "source") -> DataFrame:
    """The templates of lines (see templates_of)."""
    return templates_of(matched(df, line, key, source))


def packed(lines: DataFrame, templates: DataFrame, key: str = "event_id") -> DataFrame:
    """Each matched line as template and payload: template_key, variables, own_separators and own_trailing (null where they are the template's),
    and bytes of line and payload. Templates are found by digest, and their literals are compared."""
    tpl = templates.select("template_key", "signature", "shape", F.col("n_tokens").alias("tn"), F.col("literals").alias("tl"), F.col("separators").alias("ts"), F.col("trailing").alias("tt"))
    out = lines.join(tpl, "shape").where((F.col("n_tokens") == F.col("tn")) & F.col("literals").eqNullSafe(F.col("tl")))
    out = out.withColumns({"own_separators": F.when(F.col("separators") != F.col("ts"), F.col("separators")), "own_trailing": F.when(F.col("trailing") != F.col("tt"), F.col("trailing"))})
    payload = F.to_json(F.struct(F.col("template_key").alias("t"), F.col("variables").alias("v"), F.col("own_separators").alias("s"), F.col("own_trailing").alias("e")))
    return out.select(
        F.col("id").alias(key), "source", "line", "template_key", "signature", "literals", F.col("ts").alias("separators"), F.col("tt").alias("trailing"), "variables", "own_separators", "own_trailing",
        F.octet_length("line").alias("line_bytes"), F.octet_length(payload).alias("payload_bytes"))


def payloads(df: DataFrame, line: str = "content", key: str = "event_id", source: str = "source") -> DataFrame:
    """The lines of df as templates and payloads (see packed)."""
    lines = stored(matched(df, line, key, source), "template-matches")
    return packed(lines, templates_of(lines), key)


def reconstruct(packed: DataFrame) -> DataFrame:
    """packed with restored: the line again, from template and payload."""
    seps, tail = F.coalesce("own_separators", "separators"), F.coalesce("own_trailing", "trailing")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))
    step = lambda s, x: F.struct(F.concat(s["text"], x["s"], F.coalesce(x["t"], F.get(F.col("variables"), s["used"]))).alias("text"), (s["used"] + F.when(x["t"].isNull(), 1).otherwise(0)).alias("used"))
    pairs = F.zip_with(seps, "literals", lambda s, t: F.struct(s.alias("s"), t.alias("t")))
    return packed.withColumn("restored", F.concat(F.aggregate(pairs, start, step, lambda s: s["text"]), tail))


def _sums(done: DataFrame, templates: DataFrame) -> DataFrame:
    same = F.col("restored") == F.col("line")
    sums = done.agg(
        F.count("*").alias("records"), F.coalesce(F.sum("line_bytes"), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("payload_bytes"), F.count_if(same).alias("reconstructable"))
    defs = F.to_json(F.struct("pattern", "literals", "types", "separators", "trailing"), {"ignoreNullFields": "false"})
    meta = templates.agg(F.count("*").alias("templates"), F.coalesce(F.sum(F.octet_length(defs)), F.lit(0)).alias("definition_bytes"))
    saved = F.when(F.col("original_bytes") > 0, F.bround(100 * (1 - (F.col("payload_bytes") + F.col("definition_bytes")) / F.col("original_bytes")), 1)).otherwise(0.0)
    exact = F.when(F.col("records") > 0, F.bround(100 * F.col("reconstructable") / F.col("records"), 2)).otherwise(0.0)
    return sums.crossJoin(meta).withColumns({"reduction_pct": saved, "reconstruction_rate": exact, "lossless": F.col("records") == F.col("reconstructable")})


def accounting(df: DataFrame, line: str = "content", key: str = "event_id", source: str = "source") -> DataFrame:
    """One row: bytes before and after, saved percent (negative where templates cost more than they save), how many lines come back exactly, number of
    templates. No lines give one row of zeros."""
    lines = stored(matched(df, line, key, source), "template-matches")
    templates = stored(templates_of(lines), "templates")
    return _sums(reconstruct(packed(lines, templates, key)), templates)


def mismatches(df: DataFrame, line: str = "content", key: str = "event_id", source: str = "source", limit: int = 20) -> DataFrame:
    """The first lines, by key, that do not come back exactly, with what came back; none, unless a payload was damaged."""
    done = reconstruct(payloads(df, line, key, source))
    return done.where(~F.col("restored").eqNullSafe(F.col("line"))).select(key, "template_key", "line", "restored").orderBy(key).limit(limit)


def in_scope(lines: DataFrame, job: str | None = None, source: str | None = None) -> DataFrame:
    """The lines of one job, or of one source, or all."""
    if job is not None:
        lines = lines.where(F.col("job_id") == job)
    return lines if source is None else lines.where(F.col("source") == source)


def reports(lines: DataFrame, scopes: list[dict], line: str = "content", key: str = "event_id") -> DataFrame:
    """The accounting of several scopes, each mined by itself: job and source as in_scope takes them, and accounting's columns. A scope without lines is a row of zeros."""
    out = None
    for scope in scopes:
        job, source = (F.lit(scope.get(n)).cast("string").alias(n) for n in ("job", "source"))
        one = accounting(in_scope(lines, **scope), line, key).select(job, source, "*")
        out = one if out is None else out.unionByName(one)
    return out


def saved_templates(old: DataFrame, new: DataFrame) -> DataFrame:
    """The template store after a run: templates by signature. A known signature keeps its key and first line, and takes the rest from the run, so a rerun
    over the same lines changes nothing; new ones get the keys that follow the largest known."""
    most = F.coalesce(F.max(F.substring("template_key", 5, 20).cast("long")), F.lit(0))
    known = old.select("signature", F.col("template_key").alias("__key"), F.col("first_id").alias("__first"))
    joined = new.drop("template_key").join(known, "signature", "left")
    seen = joined.where("__key IS NOT NULL").withColumn("template_key", F.col("__key")).withColumn("first_id", F.least("first_id", "__first"))
    fresh = ranked(joined.where("__key IS NULL"), "first_id").crossJoin(old.agg(most.alias("__most"))).withColumn("template_key", _key(F.col("__most") + F.col("nth")))
    columns = new.columns
    gone = old.join(new.select("signature"), "signature", "left_anti")
    return seen.select(*columns).unionByName(fresh.select(*columns)).unionByName(gone.select(*columns))


def saved_matches(old: DataFrame, new: DataFrame, key: str = "event_id") -> DataFrame:
    """The stored matches (key, template_key, ...) after a run: each line's newest one."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def listed(templates: DataFrame, least: int | None = None, source: str | None = None, text: str | None = None, limit: int = 100) -> DataFrame:
    """Templates by occurrences, then key: of at least so many lines, of a source, with a text in their pattern."""
    if least is not None:
        templates = templates.where(F.col("occurrences") >= least)
    if source is not None:
        templates = templates.where(F.array_contains("sources", source))
    if text is not None:
        templates = templates.where(F.lower("pattern").contains(text.lower()))
    return templates.orderBy(F.desc("occurrences"), "template_key").limit(limit)


def examples(matches: DataFrame, lines: DataFrame, template: str | None = None, top: int = 5, line: str = "content", key: str = "event_id", order: str | None = None) -> DataFrame:
    """Per template (or of one), its first lines in order, with their text: template_key, nth, key, line."""
    found = matches.select(key, "template_key") if template is None else matches.where(F.col("template_key") == template).select(key, "template_key")
    found = found.join(lines.select(key, line, *([order] if order and order != key else [])), key)
    nth = F.row_number().over(W.partitionBy("template_key").orderBy(*dict.fromkeys([order or key, key])))
    return found.withColumn("nth", nth).where(F.col("nth") <= top).select("template_key", "nth", key, line)


def spans_of_time(matches: DataFrame, lines: DataFrame, at: str = "timestamp", key: str = "event_id") -> DataFrame:
    """Per template: lines, first and last time, and lines per source."""
    joined = matches.select(key, "template_key").join(lines.select(key, at, "source"), key)
    each = joined.groupBy("template_key", "source").agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))
    return each.groupBy("template_key").agg(
        F.sum("n").alias("records"), F.min("low").alias("first_seen"), F.max("high").alias("last_seen"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("by_source"))


def summary(tpl: DataFrame) -> DataFrame:
    """One row: templates, lines, mean number of variables, sources."""
    sources = tpl.select(F.explode("sources").alias("s")).agg(F.countDistinct("s").alias("sources"))
    return tpl.agg(F.count("*").alias("templates"), F.sum("occurrences").alias("occurrences"), F.bround(F.avg("variable_count"), 2).alias("avg_variables")).crossJoin(sources)
