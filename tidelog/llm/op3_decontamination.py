"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Texts are lower-cased in A-Z and cut into words of ASCII letters, digits and all non-ASCII characters.
Every run of SPAN consecutive item words is a window; an item of fewer words is one window. The k-gram
hashes of KGRAM words are winnowed: of each SPAN - KGRAM + 1 consecutive ones the smallest is kept, on both
sides by the same rule, so that a document that holds a window keeps the window's fingerprint. Documents and
benchmark meet on fingerprints, and each hit is extended to the whole window and compared word by word.
Items shorter than SPAN words are fingerprinted by their smallest single-word hash instead.

Broadcasting: the distinct benchmark windows are broadcast if their measured size is within
`broadcast_bytes`; beyond it the fingerprints are joined by shuffle, with the same result.

Defined cases: null or wordless texts have zero words and no hits; items without words or with a null id take
no part; items that repeat an id count once; every document row gives a row, repeated rows and null ids too;
of equal k-gram hashes in a window any one serves, as all places of a fingerprint are tried; a document of any length is
searched whole, in one row; an empty table gives an empty result, an empty benchmark contaminates nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, table, without

NAME = "op3_decontamination"
SPAN = 10
KGRAM = 5
BROADCAST_BYTES = 32 << 20
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Null texts have no words. One pass lower-cases and blanks the separators."""
    plain = F.translate(text, UPPER + SEPARATORS, UPPER.lower() + " " * len(SEPARATORS))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def _hashed(df: DataFrame) -> DataFrame:
    """Adds wh, the word hashes, and kh, those of the KGRAM words from each word on (fewer at the end)."""
    following = ", ".join(f"get(wh, i + {j})" for j in range(1, KGRAM))
    return df.withColumn("wh", F.expr("transform(w, x -> xxhash64(x))")).withColumn("kh", F.expr(f"transform(wh, (x, i) -> xxhash64(x, {following}))"))


def _windows(benchmark: DataFrame, span: int) -> DataFrame:
    """One row per distinct window: hash and offset of its fingerprint, its length, its text and its items."""
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.expr(f"explode_outer(sequence(0, greatest(size(w) - {span}, 0)))")
    distinct = (
        items.select("item_id", "w", starts.alias("s"))
        .select("item_id", F.expr(f"slice(w, s + 1, {span})").alias("w"))
        .groupBy("w")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    short = F.size("w") < span
    own = F.when(short, F.col("wh")).otherwise(F.expr(f"slice(kh, 1, {span - KGRAM + 1})"))
    return (
        _hashed(distinct)
        .withColumn("own", own)
        .withColumn("hash", F.array_min("own"))
        .select("hash", F.expr("cast(array_position(own, hash) - 1 as int)").alias("offset"), F.size("w").alias("length"), F.array_join("w", " ").alias("window"), "items")
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans: the hit windows as (start word, words).

    span: at least KGRAM words.
    """
    windows = _windows(benchmark, span)
    stats = windows.agg(F.sum(F.octet_length("window") + 8 * F.size("items") + 64).alias("bytes"), F.max((F.col("length") < span).cast("int")).alias("short")).first()
    small = (stats["bytes"] or 0) <= broadcast_bytes
    reach = ", ".join(f"get(kh, i + {j})" for j in range(1, span - KGRAM + 1))
    kept = F.expr(f"array_distinct(transform(kh, (x, i) -> least(x, {reach})))" if reach else "array_distinct(kh)")
    if stats["short"]:
        kept = F.array_union(kept, F.array_distinct("wh"))
    # A null fingerprint stands for the document itself, so that one pass over the texts gives counts and hits.
    # explode would add a filter on the array's size, for which all of the hashing is done again; explode_outer doesn't.
    found = (
        _hashed(documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w")))
        .withColumn("kept", F.array_append(kept, F.lit(None).cast("bigint")))
        .select("doc_id", "text_hash", "w", "wh", "kh", F.explode_outer("kept").alias("hash"))
    )
    if small:
        met = found.join(F.broadcast(windows), "hash", "left").where("hash is null or window is not null")
    else:
        met = _shuffled(found, windows)
    at = F.expr("transform(filter(sequence(0, size(own) - 1), i -> get(own, i) = hash), p -> p - offset)")
    whole = F.expr("filter(starts, s -> s >= 0 and array_join(slice(w, s + 1, length), ' ') = window)")
    hits = (
        met.select("doc_id", "text_hash", F.size("w").alias("n_words"), "hash", "offset", "length", "window", "items", F.expr("case when hash is not null then w end").alias("w"), F.expr(f"case when hash is null then null when length < {span} then wh else kh end").alias("own"))
        .withColumn("starts", at)
        .withColumn("starts", whole)
        .select("doc_id", "text_hash", "n_words", F.expr("hash is null").alias("row"), F.expr("case when size(starts) > 0 then transform(starts, s -> struct(s as start, length as words)) end").alias("spans"), F.expr("case when size(starts) > 0 then items end").alias("items"))
    )
    each = hits.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(F.col("row").cast("int")).alias("rows"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    places = F.expr("array_distinct(flatten(transform(spans, x -> sequence(x.start, x.start + x.words - 1))))")
    return (
        each.withColumn("n_hit", F.size(places).cast("long"))
        .withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort(F.expr("transform(items, x -> cast(x as string))")), ",").cast("binary"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
            F.array_sort("spans").alias("spans"),
        )
    )


def _shuffled(found: DataFrame, windows: DataFrame) -> DataFrame:
    """The same rows as the broadcast join's: light fingerprints go through the shuffle, texts meet them again by document."""
    key = ["doc_id", "text_hash"]
    light = found.where("hash is not null").select(*key, "hash").distinct()
    pairs = light.join(windows, "hash")
    texts = found.where("hash is null").drop("hash")
    once = texts.dropDuplicates(key)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    hits = pairs.alias("a").join(once.alias("b"), same).select("b.doc_id", "b.text_hash", "w", "wh", "kh", "hash", "offset", "length", "window", "items")
    return texts.withColumn("hash", F.lit(None).cast("bigint")).unionByName(hits, allowMissingColumns=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")).drop("spans")


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    found = decontaminate(documents.select("doc_id", "text"), benchmark, **options)
    return without(documents, "doc_id", found.where("contaminated").select("doc_id"))


_LOWER = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), {SPAN}) AS l, array_to_string(w[s:s + {SPAN - 1}], ' ') AS t
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SPAN - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS t
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, ls WHERE len(w) >= l)),
h AS (SELECT doc_id, s, l, item_id FROM dw JOIN iw USING (l, t)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
