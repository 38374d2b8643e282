"""The registered queries of this subpackage, with their SQL where DuckDB can express them.

Each query applies its operator to its whole table and derives digest columns from what the
operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lattice, media, mixing, neardup, pieces, pitman_yor, quality, secret_scan, shard, tokenfile
from .runtime import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _text_bytes():
    return F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.shard_rows(table(spark, sf_dir, "documents"), shards=24, seed=1)
    size, crc = (F.octet_length(_text_bytes()) + 8).cast("long"), F.crc32(_text_bytes())
    return placed.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def quality_model(documents: DataFrame, labels: DataFrame) -> quality.Model:
    """Trained on ``labels.quality`` of the documents outside the held-out fold."""
    known = labels.where(quality.fold(F.col("doc_id")) != 0).select("doc_id", F.col("quality").alias("label"))
    return quality.fit(documents, known)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.scored(documents, quality_model(documents, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(quality.fold(F.col("doc_id")) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_tokens", "ids", "decoded")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2, similarity=0.8)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_table(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(quality.fold(F.col("doc_id")) == 1, F.lit(False))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("train"))
    return pitman_yor.scored(documents).withColumn("held_out", ~F.col("train")).drop("train")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in secret_scan.BASE]))
    return found.select(
        "doc_id", *[counted(r.kind) for r in secret_scan.BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"), similarity=0.95)


OP5_SQL = r"""
with recursive listed as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
         else list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) end as s
  from listed),
class as (select min(doc_id) as id, list_sort(s) as s, len(s) as n from sets where len(s) > 0 group by list_sort(s), len(s)),
items as (select id, n, unnest(s) as item from class),
links as (
  select a.id as a, b.id as b from items a join items b on a.item = b.item and a.id <> b.id
    and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.id, b.id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached as (select id as node, id as other from class union select r.node, l.b from reached r join links l on l.a = r.other),
groups as (select node, min(other) as component from reached group by 1),
placed as (
  select t.doc_id, cast(len(t.s) as bigint) as n_shingles, coalesce(g.component, t.doc_id) as component_id
  from sets t left join class c on c.s = list_sort(t.s) and len(t.s) > 0 left join groups g on g.node = c.id)
select doc_id, n_shingles, component_id, coalesce(doc_id = component_id, true) as kept from placed
"""

OP9_SQL = r"""
with sized as (
  select doc_id, source, coalesce(text, '') as body, cast(doc_id as varchar) as id,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source),
weighted as (
  select source, source_size,
         case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w
  from sources),
ranked as (
  select *, source_size * 2.0::double / w as stop,
         row_number() over (order by source_size * 2.0::double / w, source asc nulls last) as k
  from weighted),
summed as (
  select *, cast(sum(source_size) over () as bigint) * 1.5::double as total,
         cast(coalesce(sum(source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as bigint) * 2.0::double as stopped,
         sum(w) over () - coalesce(sum(w) over (order by k rows between unbounded preceding and 1 preceding), 0) as remaining
  from ranked),
levels as (select *, (total - stopped) / remaining as level from summed),
chosen as (select arg_min(level, k) as level from levels where level <= stop),
targets as (
  select l.source, l.source_size, least(l.source_size * 2.0::double, l.w * coalesce(c.level, 'infinity'::double)) as target
  from levels l cross join chosen c),
rated as (
  select s.doc_id, s.size, t.source_size, t.target,
         case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
         cast(('0x' || substr(md5(coalesce(s.id, '') || '|' || s.body), 1, 13)) as bigint) / 4503599627370496.0::double as u
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
       size * (cast(floor(rate) as bigint) + case when u < rate - floor(rate) then 1 else 0 end) as taken
from rated
"""

OP10_SQL = """
with recursive able as (
  select vec_id, embedding from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from able a join able b on a.vec_id <> b.vec_id and len(a.embedding) = len(b.embedding)
  where list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.95),
reached as (select vec_id as node, vec_id as other from able union select r.node, l.b from reached r join links l on l.a = r.other),
groups as (select node, min(other) as component from reached group by 1),
degrees as (select a, count(*) as n from links group by 1)
select e.vec_id, coalesce(d.n, 0) as n_links, coalesce(g.component, e.vec_id) as component_id, coalesce(e.vec_id = coalesce(g.component, e.vec_id), true) as kept
from embeddings e left join groups g on g.node = e.vec_id left join degrees d on d.a = e.vec_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_media_columns": op4_media_columns,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_token_files": op6_token_files,
    "op7_pitman_yor": op7_pitman_yor,
    "op8_secret_scans": op8_secret_scans,
    "op9_mixing": op9_mixing,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}
SQL: dict[str, str] = {"op5_minhash_near_dedup": OP5_SQL, "op9_mixing": OP9_SQL, "op10_embedding_near_dedup": OP10_SQL}
