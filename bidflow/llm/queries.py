"""Queries of the text operators over the given tables, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm import clusters, decontamination, fingerprints, language, line_dedup, lm, mixing, near_dedup, periodic, quality
from bidflow.llm import secrets, token_counts, toxicity
from bidflow.llm.common import remainder, table
from bidflow.shared import staged

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.scores(docs.withColumn("held_out", remainder(F.col("doc_id"), 7) == 2))


def op2_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    rows = staged(quality.with_statistics(docs.withColumn("held_out", held_out)), "statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(rows.where(~F.col("held_out")).join(labels, "doc_id"))
    scored = rows.withColumn("score", quality.score(F.col("x"), model))
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.scored(docs, chain).drop("text")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.with_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.col("leaks.item_id").alias("item_ids"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    model = language.fit(docs.where(~F.col("held_out")))
    return language.predicted(docs.drop("lang"), model)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs).select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.col("n_dropped").cast("bigint").alias("n_dropped"),
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs).drop("id", "class")


def planted_periods(docs: DataFrame) -> DataFrame:
    """Documents of which each tenth, by the hash of its id, has repeats from a word on; their words have one space between them."""
    white = "[\\x20\\x09-\\x0D]+"
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeats(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        repeated = F.transform(words, lambda x, i: F.when(i < a, x).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))
        return F.array_join(repeated, " ")

    bare = F.btrim(F.col("text"), F.lit(line_dedup.WHITE))
    planted = (h % 10 == 0) & (F.length(bare) > 0)
    return docs.withColumn("text", F.when(planted, line_dedup.let(F.split(bare, white, -1), repeats)).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = periodic.with_runs(planted_periods(docs)).drop("text")
    # The longest run; of several the one with the smallest start, then period.
    ranked = F.transform("runs", lambda r: F.struct(-r["length"], r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(ranked)
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.col1")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(-F.col("best.col1") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters.clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    listed = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        F.sha2(listed.cast("binary"), 256).alias("centroid_sha256"),
    )


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.without_text(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("shapes", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{name}") for kind, name in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.listed(F.col("shapes")).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


OP8_SQL = """
with d as (
  select row_number() over () as row_no, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
),
l as (select row_no, unnest(lines) as line, generate_subscripts(lines, 1) as position from d),
k as (
  select row_no, position, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l
),
f as (select key from k where key <> '' group by key having count(distinct row_no) >= 10),
s as (
  select k.row_no, count(f.key) as n_dropped,
    string_agg(case when f.key is null then line end, chr(10) order by position) as kept
  from k left join f on k.key = f.key group by k.row_no
)
select doc_id, len(lines) as n_lines, n_dropped, sha256(coalesce(kept, '')) as kept_sha256
from d join s using (row_no)
"""

# Levels: the share of a weight of one once the sources before (by size over weight) stop at their most.
OP5_SQL = r"""
with d as (
  select row_number() over () as row_no, doc_id, source,
    md5('17|' || coalesce(cast(doc_id as varchar), md5(coalesce(text, '')))) as draw,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
  from documents
),
s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as n,
    cast(case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as double) as weight,
    list_max(list_filter([1, 2, 4, 8, 16, 32, 64], lambda b: b = 1 or 64 * b <= sum(size))) as length
  from d group by source
),
level as (
  select n, weight, 2 * source_size as most,
    (1.5 * sum(source_size) over () - coalesce(sum(2 * source_size) over before, 0)) / sum(weight) over after as level
  from s where source_size > 0
  window before as (order by source_size / weight, n rows between unbounded preceding and 1 preceding),
    after as (order by source_size / weight, n rows between current row and unbounded following)
),
goal as (
  select n, length, least((select level from level where level * weight <= most order by most / weight, n limit 1) * weight, cast(most as double)) as target from level join (select n, length from s) using (n)
),
placed as (
  select d.*, s.n, s.length, s.source_size, coalesce(g.target, 0.0) as target,
    cast('0x' || substr(draw, 1, 8) as bigint) % greatest(1, cast(ceil(source_size / 1000000) as bigint)) as shard
  from d join s on s.source is not distinct from d.source left join goal g on g.n = s.n
),
shards as (
  select n, shard, cast(sum(size) as bigint) as words, cast(ceil(sum(size) / any_value(length)) as bigint) as blocks
  from placed where size > 0 group by n, shard
),
caps as (select n, any_value(length) as length, any_value(target) as target, 2 * sum(blocks) as cap from shards join goal using (n) group by n),
bids as (select n, length, target / (2 * unnest(range(0, cast(cap as bigint))) + 1) as quotient from caps),
seats as (
  select n, count(*) as seats from (
    select n, length, row_number() over (partition by length order by quotient desc, n) as place from bids
  ) join (select length, cast(round_even(sum(target) / length, 0) as bigint) as wanted from goal group by length) using (length)
  where place <= wanted group by n
),
shard_bids as (select n, shard, words / (2 * unnest(range(0, 2 * blocks)) + 1) as quotient from shards),
quotas as (
  select n, shard, count(*) as quota from (
    select n, shard, row_number() over (partition by n order by quotient desc, shard) as place from shard_bids
  ) join seats using (n) where place <= seats group by n, shard
),
blocks as (
  select n, shard, block, coalesce(quota, 0) // blocks + case when row_number() over (
      partition by n, shard order by md5('17|' || n || '|' || shard || '|' || block), block) <= coalesce(quota, 0) % blocks
    then 1 else 0 end as times
  from (select n, shard, blocks, unnest(range(0, blocks)) as block from shards) left join quotas using (n, shard)
),
line as (
  select *, sum(size) over (partition by n, shard order by draw, doc_id, size rows unbounded preceding) as ends
  from placed where size > 0
),
cut as (
  select row_no, n, shard, length, ends, size,
    unnest(range(cast((ends - size) // length as bigint), cast((ends - 1) // length + 1 as bigint))) as block
  from line
),
taken as (
  select row_no, sum((least(ends, (block + 1) * length) - greatest(ends - size, block * length)) * times) as taken
  from cut join blocks using (n, shard, block) group by row_no
)
select p.doc_id, p.source, p.size, p.source_size, p.target, cast(coalesce(t.taken, 0) as bigint) as taken
from placed p left join taken t using (row_no)
"""

# The table of CRC-32 is made by its rule; equal words are joined in their document, and neighbours on a lag make stretches.
OP11_SQL = r"""
with crc as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i)) as t
),
h as (
  select row_number() over () as row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    xor(4294967295, list_reduce(
      list_transform(list_filter(string_split(coalesce(cast(doc_id as varchar), ''), ''), lambda c: c <> ''), lambda c: cast(ascii(c) as bigint)),
      lambda c, b: xor(t[cast(xor(c, b) & 255 as integer) + 1], c >> 8), 4294967295)) as h
  from documents, crc
),
d as (
  select *, len(words) as n, (h // 10) % greatest(1, len(words)) as a, h // 10 as g from h
),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from d),
placed as (
  select row_no, doc_id, n, case when h % 10 = 0 and n > 0
    then list_transform(range(n), lambda i: words[cast(case when i < a then i else a + (i - a) % p end as integer) + 1])
    else words end as words
  from p
),
w as (select row_no, n, unnest(words) as word, generate_subscripts(words, 1) - 1 as i from placed),
equal as (
  select x.row_no, y.i - x.i as lag, x.i from w x join w y
    on x.row_no = y.row_no and x.word = y.word and y.i > x.i and 2 * (y.i - x.i) <= x.n
),
islands as (select *, i - row_number() over (partition by row_no, lag order by i) as island from equal),
stretches as (
  select row_no, lag, min(i) as start, count(*) + lag as length from islands group by row_no, lag, island
),
runs as (
  select row_no, start, length, min(lag) as period from stretches
  where length >= 12 and length >= 2 * lag group by row_no, start, length
),
listed as (
  select row_no, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as text
  from runs group by row_no
),
best as (
  select * from runs qualify row_number() over (partition by row_no order by length desc, start, period) = 1
),
dropped as (
  select distinct row_no, unnest(range(start + period, start + length)) as i from runs
),
kept as (
  select row_no, string_agg(word, ' ' order by i) as text from w anti join dropped using (row_no, i) group by row_no
)
select doc_id, coalesce(l.n_runs, 0) as n_runs, b.start, b.length, b.period, (1000 * b.length) // b.period as exponent_milli,
  sha256(coalesce(l.text, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from placed left join listed l using (row_no) left join best b using (row_no) left join kept k using (row_no)
"""


def op12_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Rounds written out: each assigns all vectors and then moves the centroids."""

    def assigned(r: int) -> str:
        return f"""a{r} as (
  select row_no, c as cluster, distance from (
    select row_no, c, cast(list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as distance
    from kept, c{r}
  ) qualify row_number() over (partition by row_no order by distance, c) = 1
)"""

    def moved(r: int) -> str:
        return f"""m{r} as (
  select cluster, list(mean order by i) as v from (
    select cluster, i, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as bigint) as mean
    from a{r - 1} join parts using (row_no) group by cluster, i
  ) group by cluster
),
c{r} as (select c, coalesce(m{r}.v, c{r - 1}.v) as v from c{r - 1} left join m{r} on cluster = c)"""

    steps = [step for r in range(1, rounds + 1) for step in (assigned(r - 1), moved(r))]
    joined = ",\n".join([*steps, assigned(rounds)])
    return f"""
with kept as (
  select row_number() over () as row_no, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
parts as (select row_no, unnest(v) as x, generate_subscripts(v, 1) as i from kept),
c0 as (
  select row_number() over (order by draw, v) - 1 as c, v from (
    select sha256('2:' || coalesce(cast(vec_id as varchar), '')) as draw, v from kept order by draw, v limit {k}
  )
),
{joined},
shares as (select cluster, cast(sum(distance) as bigint) as cluster_inertia from a{rounds} group by cluster)
select vec_id, cast(cluster as integer) as cluster, distance, cluster_inertia,
  (select cast(sum(distance) as bigint) from a{rounds}) as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from a{rounds} join kept using (row_no) join shares using (cluster) join c{rounds} on c = cluster
"""


QUERIES: dict[str, Query] = {
    "op1_lm_scores": op1_lm_scores,
    "op2_phrase_fingerprints": op2_phrase_fingerprints,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op10_language": op10_language,
    "op5_mix_sources": op5_mix_sources,
    "op8_line_dedup": op8_line_dedup,
    "op9_near_duplicates": op9_near_duplicates,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_secrets": op13_secrets,
}

TWINS: dict[str, str] = {"op5_mix_sources": OP5_SQL, "op8_line_dedup": OP8_SQL, "op11_periodic_runs": OP11_SQL, "op12_centroid_clusters": op12_sql()}
