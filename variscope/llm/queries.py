"""Named queries of the operators in this folder and their DuckDB statements."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from variscope.llm import bpe, conversations, filter_audit, fingerprints, jaccard, licences, mixing, personal, quality, token_files, toxicity, vectors, warc
from variscope.llm.common import table

#: The public vocabulary that the queries encode with; operators take any path.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


MIX_SQL = """
with facts as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 12))::bigint::double + 1) / 281474976710656.0)
      / greatest(0.25, coalesce(length(regexp_replace(text, '[^\\p{L} ]+', '', 'g'))::double / greatest(length(text), 1), 0.0)) as key
  from documents),
sources as (select source, sum(size)::bigint as source_size from facts group by source),
ranked as (select *, [1, 2, 3][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int] as w, source_size * 3 as cap,
    sum(source_size) over ()::double as budget from sources),
leveled as (select *, (budget - coalesce(sum(cap) over o, 0)) / (sum(w) over () - coalesce(sum(w) over o, 0)) as level
  from ranked window o as (order by cap::double / w, encode(source) nulls last rows between unbounded preceding and 1 preceding)),
final as (select level from leveled where cap >= level * w order by cap::double / w limit 1),
plan as (select l.source, l.source_size, case when f.level is null then cap::double else least(cap::double, f.level * w) end as target
  from leveled l left join final f on true),
rest as (select *, case when source_size > 0 then floor(target / source_size)::int else 0 end as epochs from plan),
filled as (
  select f.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size as rest,
    coalesce(sum(f.size) over (partition by f.source order by f.key, f.doc_id, f.size rows between unbounded preceding and 1 preceding), 0) as before
  from facts f join rest p on f.source is not distinct from p.source)
select doc_id, size::bigint as size, source_size, target,
  (size * (epochs + case when rest > before and (rest - before) * 2 >= size then 1 else 0 end))::bigint as taken
from filled"""


@query()
def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality_of_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query(MIX_SQL)
def op2_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents mixed to target words of each source."""
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op4_bpe_automaton(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of ids and decoded texts by the token automaton."""
    ids = bpe.encode_bpe(table(spark, sf, "documents").select("doc_id", "text"), VOCABULARY).drop("text")
    decoded = bpe.decode_bpe(ids, VOCABULARY)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(licences.licence_sql())
def op5_licences(spark: SparkSession, sf: str) -> DataFrame:
    """Licences that every document names."""
    found = licences.scan_licences(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licence_ids", ",").alias("licence_ids"), F.array_join("licences", ",").alias("licences"))


@query()
def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written to token files and read back."""
    docs = table(spark, sf, "documents")
    folder = token_files.token_folder(docs)
    return token_files.read_token_files(token_files.write_token_files(docs, folder, VOCABULARY), folder)


@query()
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity_of_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op3_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document: base spans as a digest, and all spans."""
    found = personal.find_personal(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[personal.count(F.col("base"), k).alias(f"n_{k}") for k in personal.KINDS],
        F.sha2(personal.written(F.col("base")), 256).alias("base_sha256"), personal.written(F.col("spans")).alias("spans"),
    )


@query()
def op9_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with estimated likeness."""
    docs = fingerprints.with_next(table(spark, sf, "documents"))
    docs = docs.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text"))).drop("next_text")
    docs = fingerprints.with_fingerprint(docs, "edited", "edited_fingerprint")
    own, other, following = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("next_fingerprint")
    return docs.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(own).alias("fingerprint"), fingerprints.as_text(other).alias("edited_fingerprint"),
        fingerprints.resemblance(own, other).alias("near_edited"), fingerprints.resemblance(own, following).alias("near_next"),
    )


@query()
def op10_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of all vectors."""
    return vectors.near_vectors(table(spark, sf, "embeddings"))


@query()
def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents that share 85 per cent of their shingles."""
    return jaccard.linked_components(table(spark, sf, "documents"))


@query(filter_audit.AUDIT_SQL)
def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What each of five filters removes in every order of them, by source."""
    return filter_audit.audit(filter_audit.mask_counts(table(spark, sf, "documents"), table(spark, sf, "labels")))


@query(warc.WARC_SQL)
def op13_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written to web archives and read back by way of their index."""
    pages = table(spark, sf, "pages")
    return warc.read_warc(warc.write_warc(pages, warc.warc_folder(pages))).drop("url")


@query()
def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Faults of damaged conversations and their cheapest repair."""
    return conversations.repair_conversations(table(spark, sf, "conversations"))[0]
