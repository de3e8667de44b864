"""Registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlattice.llm import bitpack, decontam, jaccard_tgm, license_scan, merkle, periodic, pii_fpe, quality_fm, seqpack, simhash_gray, topk_ip, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers ``fn(spark, sf_dir)`` under its own name."""

    def deco(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PII_KEY = b"barlattice-example-key"  # a deployment passes its own secret
VOCABULARY = 50_257
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("""
with u as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
r(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m as (select page_id, host, path, h || p as rule, v, row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) k
      from u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') verdict from u left join m on m.page_id = u.page_id and m.k = 1""")
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


TRAIN_PER_CLASS = 3000  # labelled rows of each class that a classifier is fitted on, at most


def fit_quality(spark: SparkSession, sf_dir: str) -> quality_fm.Model:
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    sample = quality_fm.labelled_sample(table(spark, sf_dir, "labels"), "quality", learn, TRAIN_PER_CLASS)
    return quality_fm.fit(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), sample)


@query()
def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = quality_fm.score(docs, fit_quality(spark, sf_dir))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query(decontam.oracle())
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = bitpack.write_tokens(table(spark, sf_dir, "documents"), bitpack.token_folder(spark), tokenizer(), VOCABULARY)
    return bitpack.read_tokens(manifest)


@query()
def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii_fpe.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    n = F.aggregate(F.map_values("pii"), F.lit(0).cast("long"), lambda a, x: a + x)
    return done.select("doc_id", "text", n.alias("n_replaced"), F.array_join(F.sort_array(F.map_keys("pii")), ",").alias("kinds"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    sample = quality_fm.labelled_sample(table(spark, sf_dir, "labels"), "toxic", ~held, TRAIN_PER_CLASS)
    scored = toxicity.score(docs, toxicity.fit(docs, sample))
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(license_scan.oracle())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.known_digests(spark))


@query("""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [list_aggregate(w, 'string_agg', ' ')]
      else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) end s from w),
k as (select s, len(s) n, min(doc_id) rep from (select doc_id, list_sort(s) s from s) group by s),
t as (select rep, n, unnest(s) t from k),
c as (select a.rep u, b.rep v, a.n m, b.n n, count(*) c from t a join t b on a.t = b.t and a.rep <> b.rep and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n group by all),
l as (select u, v from c where 100 * c >= 90 * (m + n - c)),
r as (select rep, rep as o from k union select r.rep, l.v from r join l on l.u = r.o),
f as (select rep, min(o) o from r group by rep)
select s.doc_id, len(s.s) n_shingles, case when len(s.s) = 0 then s.doc_id else f.o end component_id from s join k on list_sort(s.s) = k.s join f using (rep)""")
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tgm.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, num=90)


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) x from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.x, c.x) as bigint) score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) k from p)
select query_id, cast(k as integer) rank, vec_id, score from r where k <= 5""")
def op9_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_ip.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query()
def op10_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqpack.pack(table(spark, sf_dir, "documents"), tokenizer()).drop("ids")


def plant_period(text, h):
    """Of a text with words: those from word ``g % n`` on repeat with period ``1 + (n - a) div (3 + g % 8)``, g being h div 10."""
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.when(n > 0, F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))), " "))

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.get(F.transform(F.array(words), planted), 0)  # the words are cut once and bound


@query()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string"))
    text = F.when(h % 10 == 0, plant_period(F.col("text"), h)).otherwise(F.col("text"))
    done = periodic.collapse(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query()
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash_gray.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query(merkle.oracle())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    done = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed=tampered, now={"text": merkle.lower_ascii(F.col("text"))})
    folded = done.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.fold(F.col("path"), F.col("now")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
