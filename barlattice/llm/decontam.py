"""Documents that hold passages of a benchmark, as a prefix-filtered set join in DataFrame functions.

Item windows are sets of words to be contained in full, so any one word of a window is a sufficient prefix.  Words are ordered by
their count over all documents and each window is joined by its rarest word only.  A hit at word ``p`` fixes where the window
would have to start; the length and position bounds drop starts outside the document, and the words there are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlattice.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def item_windows(items: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, win``: the windows of ``size`` words of each item; a shorter item is one window, an item without words none."""
    listed = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return listed.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(size)).alias("win")).distinct()


def _small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def scan(docs: DataFrame, items: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
         max_broadcast_windows: int = 200_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside an occurring window), n_items, items_sha256, contaminated.

    Documents or items without words, null ones among them, match nothing.  Items with a null id count their words as hit but are no listed item.
    Long texts are taken whole; rows of equal id are judged one by one, other columns are not read, no documents give no rows and no items no hits.  Benchmarks of up to
    ``max_broadcast_windows`` windows (some 50 MB of words) are broadcast, larger ones are joined by shuffles.
    """
    windows = item_windows(items, size, item_id, item_text)
    n = windows.count()
    vocabulary = windows.select(F.explode("win").alias("word")).distinct().select(F.xxhash64("word").alias("h")).distinct()
    # rarity over all documents of the words that windows use; words the documents lack come first
    said = docs.select(F.explode(words(F.col(text))).alias("word")).select(F.xxhash64("word").alias("h"))
    counts = said.join(_small(vocabulary, n, max_broadcast_windows), "h").groupBy("h").agg(F.count("*").alias("n"))
    places = windows.select("item_id", "win", F.posexplode("win").alias("at", "word")).withColumn("h", F.xxhash64("word"))
    rare = places.join(_small(counts, n, max_broadcast_windows), "h", "left").groupBy("item_id", "win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at", "h")).alias("r"))
    # one entry per distinct window; a document's own row is kept by the entry of the empty word that ends each list
    keys = rare.filter("r.n > 0").groupBy("win").agg(F.first("r.h").alias("h"), F.first("r.at").alias("at")).select("h", "at", "win")
    spark = docs.sparkSession
    end = spark.range(1).select(F.xxhash64(F.lit("")).alias("h"), F.lit(0).alias("at"), F.lit(None).cast("array<string>").alias("win"))
    keys = _small(keys.unionByName(end), n, max_broadcast_windows)
    listed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    tokens = listed.select("row", "doc_id", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("p", "word"))
    tokens = tokens.select("row", "doc_id", "w", "p", F.xxhash64("word").alias("h"))
    start = F.col("p") - F.col("at")
    bounds = (start >= 0) & (start + F.size("win") <= F.size("w"))
    exact = F.when(bounds, F.slice("w", start + 1, F.size("win")) == F.col("win"))
    found = tokens.join(keys, "h").filter(F.col("win").isNull() | exact)
    found = found.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.when(F.col("win").isNotNull(), start).alias("lo"), "win")
    shared_dir(spark)
    found = found.checkpoint()  # read twice below; a row per document and per occurrence
    # words hit: each occurrence counts what reaches beyond all earlier ones of its document
    before = Window.partitionBy("row").orderBy(F.col("lo").asc_nulls_first(), "hi").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.withColumn("hi", F.col("lo") + F.size("win"))
    reach = F.greatest(F.col("lo"), F.coalesce(F.max("hi").over(before), F.lit(0)))
    own = spans.withColumn("new", F.greatest(F.col("hi") - reach, F.lit(0)))
    per_doc = own.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.coalesce(F.sum("new"), F.lit(0)).cast("long").alias("n_hit"))
    named = found.filter(F.col("win").isNotNull()).select("row", "win").distinct().join(_small(windows, n, max_broadcast_windows), "win")
    named = named.filter(F.col("item_id").isNotNull()).groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return per_doc.join(named, "row", "left").select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def oracle(size: int = 10) -> str:
    """The scan of ``documents`` for ``benchmark`` as DuckDB SQL."""

    def split(x: str) -> str:
        return f"list_filter(regexp_split_to_array(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda x: x <> '')"

    return f"""
with d as (select doc_id, {split('text')} w from documents),
i as (select item_id::varchar item_id, {split('text')} w from benchmark),
iw as (select distinct item_id, list_slice(w, s, s + {size - 1}) win from i, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) t(s) where len(w) > 0),
sizes as (select distinct len(win) n from iw),
dw as (select doc_id, s, n, list_slice(w, s, s + n - 1) win from d, sizes, unnest(range(1, len(w) - n + 2)) t(s)),
h as (select doc_id, s, n, item_id from dw join iw using (win)),
p as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from h) group by doc_id),
l as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join p using (doc_id) left join l using (doc_id)"""
