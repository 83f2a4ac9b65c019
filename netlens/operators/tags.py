"""Tags of field values by rules: longest prefix, else exact value, else longest suffix.

A rule lookup is an equi-join: a value is cut to each length that some rule has, and the
cuts meet the rules by equality. So a million rules cost no more than their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_TAGS = 128
_PRIORITY = {"PREFIX": 3, "EXACT": 2, "SUFFIX": 1}


def load(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a file {"rules": [{"value", "matchingType", "tag"[, "key"]}]}."""
    schema = "rules array<struct<key:string,value:string,matchingType:string,tag:string>>"
    rules = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("rules").alias("seq", "r"))
    return rules.select(F.col("seq").cast("long").alias("seq"), "r.key", "r.value", "r.matchingType", "r.tag")


def normalised(rules: DataFrame) -> DataFrame:
    """key, kind, piece, size, tag: lower case; of rules that agree the last one counts."""
    own = rules.where(F.col("value").isNotNull() & F.col("tag").isNotNull())
    own = own.select("seq", F.lower(F.coalesce("key", F.lit(""))).alias("key"), F.upper("matchingType").alias("kind"), F.lower("value").alias("piece"), "tag")
    own = own.where(F.col("kind").isin(*_PRIORITY)).groupBy("key", "kind", "piece").agg(F.max_by("tag", "seq").alias("tag"))
    return own.withColumn("size", F.length("piece"))


def lookup(values: DataFrame, rules: DataFrame, value: str, by: list[str], key: Column | None = None) -> DataFrame:
    """``by`` and tag: the tag of each value, identified by the columns ``by``; values without one are left out."""
    known = normalised(rules)
    sizes: dict[str, list[int]] = {}
    for r in known.select("kind", "size").distinct().collect():  # at most three times the length of the longest rule
        sizes.setdefault(r.kind, []).append(r.size)
    v = F.lower(F.col(value))
    cut = lambda kind, n, x: F.struct(F.lit(kind).alias("kind"), F.lit(_PRIORITY[kind]).alias("p"), F.when(F.length(v) >= n, x).alias("piece"))
    cuts = [cut("PREFIX", n, F.substring(v, 1, n)) for n in sorted(sizes.get("PREFIX", ()))]
    cuts += [cut("EXACT", 0, v)] if "EXACT" in sizes else []
    cuts += [cut("SUFFIX", n, F.right(v, F.lit(n))) for n in sorted(sizes.get("SUFFIX", ()))]
    if not cuts:
        return values.select(*by, F.lit(None).cast("string").alias("tag")).where("false")
    tried = values.select(*by, F.lower(key).alias("key") if key is not None else F.lit("").alias("key"), F.explode(F.array(*cuts)).alias("c"))
    tried = tried.select(*by, "key", "c.kind", "c.p", "c.piece").where(F.col("piece").isNotNull())
    return tried.join(known, ["key", "kind", "piece"]).groupBy(*by).agg(F.max_by("tag", F.struct("p", "size")).alias("tag"))


def of_pairs(values: DataFrame, rules: DataFrame, pairs: str, by: list[str]) -> DataFrame:
    """``by`` and tags: those of an array of (key, value) in order, looked up by key."""
    each = values.select(*by, F.posexplode(pairs).alias("pos", "kv")).select(*by, "pos", "kv.key", "kv.value")
    found = lookup(each.withColumnRenamed("key", "k"), rules, "value", [*by, "pos"], F.col("k"))
    sorted_tags = F.array_sort(F.collect_list(F.struct("pos", "tag")))  # of one array
    return found.groupBy(*by).agg(F.slice(F.transform(sorted_tags, lambda x: x["tag"]), 1, MOST_TAGS).alias("tags"))
