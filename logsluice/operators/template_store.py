"""Templates that are kept between runs: lines are matched against them first, and only the others are mined.

The index of a store has one entry per template: the number of its tokens, the places of its first literals and their digest. A line is looked
up once for each set of places that templates of its length have; what is found is compared literal by literal, and the template with
the most literals is the line's (of several, the one with the smallest key). Lines that an earlier run matched are left out, so a run over old and new lines
counts and mines the new ones only, and keys never change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import KeyedTable
from ..functions.store import settled, stored
from . import templates as T

#: Literals of a template that its entry is found by.
LEADING = 3
#: Sets of places of all templates up to which they are broadcast; beyond, lines of one length are dealt out over SALTS parts.
MOST_PLACES, SALTS = 100_000, 64


def index(templates: DataFrame) -> DataFrame:
    """template_key, shape, n_tokens, literals, n_literals, places, entry."""
    places = F.filter(F.transform("literals", lambda t, i: F.when(t.isNotNull(), i)), lambda i: i.isNotNull())
    rows = templates.select("template_key", "shape", "n_tokens", "literals", places.alias("all"))
    rows = rows.select("template_key", "shape", "n_tokens", "literals", F.size("all").alias("n_literals"), F.slice("all", 1, LEADING).alias("places"))
    return rows.withColumn("entry", _entry("literals"))


def _entry(tokens: str) -> Column:
    return F.xxhash64("n_tokens", "places", F.transform("places", lambda p: F.get(F.col(tokens), p)))


def _with_places(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """lines, once per set of places that templates of their length have."""
    ways = stored(entries.groupBy("n_tokens").agg(F.collect_set("places").alias("ways")), "template-places")
    if (ways.agg(F.sum(F.size("ways"))).first()[0] or 0) <= MOST_PLACES:
        placed = lines.join(F.broadcast(ways), "n_tokens")
    else:
        ways = ways.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(ways, ["n_tokens", "salt"]).drop("salt")
    return placed.withColumn("places", F.explode("ways")).drop("ways")


def match(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """(row, template_key) of the lines (row, n_tokens, tokens) that a template fits."""
    entries = index(templates)
    tried = _with_places(lines.select("row", "n_tokens", "tokens"), entries).withColumn("entry", _entry("tokens"))
    tried = tried.select("row", "entry", F.col("n_tokens").alias("n"), "tokens")
    fits = F.forall(F.zip_with("literals", "tokens", lambda t, x: t.isNull() | (t == x)), lambda ok: ok)
    found = tried.join(entries, "entry").where((F.col("n") == F.col("n_tokens")) & fits)
    best = F.min(F.struct((-F.col("n_literals")).alias("least"), F.length("template_key").alias("digits"), "template_key"))
    return found.groupBy("row").agg(best.alias("best")).select("row", "best.template_key")


def _lines(tok: DataFrame, found: DataFrame, templates: DataFrame) -> DataFrame:
    """Matched lines as templates.matched gives them."""
    of = found.join(templates.select("template_key", "literals", "shape"), "template_key").drop("template_key")
    out = tok.join(of, "row")
    variables = F.transform(F.filter(F.arrays_zip("tokens", "literals"), lambda x: x["literals"].isNull()), lambda x: x["tokens"])
    out = settled(out.select("id", "line", "source", "n_tokens", "separators", "trailing", "literals", variables.alias("variables"), "shape"))
    return out.withColumn("kinds", F.transform("variables", lambda t: F.coalesce(T.token_class(t), F.lit("value"))))


def mine_more(lines: DataFrame, templates: DataFrame, matches: DataFrame, line: str = "content", key: str = "event_id", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """What a run over lines adds to a store. templates and matches: the store so far. Returns the templates that changed or are new (occurrences: of the
    new lines alone), and the new lines' matches, as templates.packed gives them."""
    fresh = lines.join(matches.select(key), key, "left_anti").select(F.col(key).alias("id"), F.col(line).alias("line"), F.col(source).alias("source"))
    tok = stored(T.tokenised(fresh, "line").withColumn("row", F.monotonically_increasing_id()), "store-lines")
    found = stored(match(tok, templates), "store-found")
    known = stored(_lines(tok, found, templates), "store-known")
    seen = known.groupBy("shape", "literals").agg(F.count("*").alias("n"), F.max("id").alias("most"), F.min("id").alias("least"), F.collect_set("source").alias("more"))
    changed = templates.alias("t").join(seen.alias("s"), (F.col("t.shape") == F.col("s.shape")) & F.col("t.literals").eqNullSafe(F.col("s.literals")))
    changed = changed.select(
        *[f"t.{c}" for c in templates.columns if c not in ("occurrences", "first_id", "last_id", "sources")], F.col("n").alias("occurrences"), F.least("t.first_id", "least").alias("first_id"),
        F.greatest("t.last_id", "most").alias("last_id"), F.sort_array(F.array_union("t.sources", "more")).alias("sources"))
    rest = stored(T.masked(tok.join(found, "row", "left_anti").drop("row")), "store-rest")
    new = T.saved_templates(templates, T.templates_of(rest)).join(templates.select("template_key"), "template_key", "left_anti")
    new = stored(new.select(*templates.columns), "store-new")
    packed = T.packed(known, templates, key).unionByName(T.packed(rest, new, key))
    return changed.select(*templates.columns).unionByName(new), packed


class TemplateStore:
    """Templates by signature and matches by line, in keyed tables under a folder."""

    def __init__(self, spark: SparkSession, path: str, key: str = "event_id", buckets: int = 16):
        self.spark, self.key = spark, key
        self.templates = KeyedTable(spark, f"{path}/templates", "signature", buckets)
        self.matches = KeyedTable(spark, f"{path}/matches", key, buckets)

    def run(self, lines: DataFrame, number: int, line: str = "content", source: str = "source") -> bool:
        """Matches and mines the lines that are new, as batch `number`; False if that batch was taken before. Matches are stored after templates: a run that
        is lost between the two is repeated with the same number, finds its templates taken, and matches every line to them."""
        if self.matches.exists() and self.matches.manifest()["batches"].get("runs", -1) >= number:
            return False
        if not self.templates.exists():
            found = stored(T.matched(lines, line, self.key, source), "store-rest")
            templates = stored(T.templates_of(found), "store-new")
            packed = T.packed(found, templates, self.key)
        else:
            old = self.templates.read()
            matches = self.matches.read() if self.matches.exists() else self.spark.createDataFrame([], lines.select(self.key).schema)
            templates, packed = mine_more(lines, old, matches, line, self.key, source)
        # both rest on stored tables and on files that later versions of the store leave as they are; upsert stores its batch itself
        self.templates.upsert(templates, "runs", number, {"occurrences": "sum", "template_key": "old"})
        self.matches.upsert(packed.select(self.key, "source", "template_key", "signature", "variables", "own_separators", "own_trailing", "line_bytes", "payload_bytes"), "runs", number)
        return True

    def payloads(self) -> DataFrame:
        """Matches with what templates.reconstruct needs."""
        tpl = self.templates.read().select("signature", "literals", "separators", "trailing")
        return self.matches.read().join(tpl, "signature")
