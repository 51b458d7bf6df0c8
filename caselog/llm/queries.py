"""The corpus operators on the given tables, one query each, with SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselog.llm import (conversations, decontaminate, exact_dedup, labelled, line_dedup, near_dedup, pieces, pii, quality_classifier, quality_rules,
                         sharding, token_output, toxicity, whitening)
from caselog.session import durable, remove_folder, shared_root

SHARDS = 24


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size")
    meta = docs.select("doc_id", "lang", "source", size, F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.kd_shards(meta, sharding.document_dims(), F.xxhash64("doc_id", "text_crc32"), ["doc_id"], shards=SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_root(spark)}/tokens-{uuid.uuid4().hex}"
    token_output.write_tokens(_table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"))
    back = durable(token_output.token_digests(spark, folder))
    remove_folder(spark, folder)
    return back


def bottom_k_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("deleted").cast("long").alias("n_deleted"), F.array_join(F.col("deleted").cast("array<string>"), ",").alias("deleted"),
                        F.md5(F.col("text").cast("binary")).alias("text_md5"))


WINNOWED_SQL = r"""
with d as (select doc_id, text, string_split(text, chr(10)) as raw from documents),
l as (select doc_id, unnest(generate_series(0, len(raw) - 1)) as pos, regexp_replace(unnest(raw), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as line from d),
s as (select *, sum(words) over (partition by doc_id order by pos) as stop from (
  select doc_id, pos, line, len(regexp_split_to_array(line, '[\x20\x09-\x0D]+')) as words from l where line <> '')),
t as (select *, cast(stop - words as bigint) as start, cast(stop as bigint) as stop_ from s),
w as (
  select doc_id, min(pos) over f as lo, max(pos) over f as hi, sum(words) over f as total, 0 as kind, list(line) over f as body from t
    window f as (partition by doc_id order by start range between current row and 49 following)
  union all
  select doc_id, min(pos) over b, max(pos) over b, sum(words) over b, 1, list(line) over b from t
    window b as (partition by doc_id order by stop_ range between 49 preceding and current row)),
q as (select *, first_value(struct_pack(a := doc_id, b := lo)) over (partition by kind, body order by doc_id, lo) as first from w where total >= 50),
gone as (select distinct doc_id, unnest(generate_series(lo, hi)) as pos from q where first.a <> doc_id or first.b <> lo),
lists as (select doc_id, list(pos order by pos) as deleted from gone group by doc_id)
select doc_id, cast(coalesce(len(deleted), 0) as bigint) as n_deleted, coalesce(array_to_string(deleted, ','), '') as deleted,
  md5(case when deleted is null then text else array_to_string(list_transform(list_filter(generate_series(0, len(raw) - 1), lambda i: not list_contains(deleted, i)), lambda i: raw[i + 1]), chr(10)) end) as text_md5
from d left join lists using (doc_id)"""


def host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_host_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


HOST_SQL = r"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
w as (select r, doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select r, w, unnest(generate_series(1, len(w) - 2)) as i from w where len(w) >= 3)),
again as (select r, unnest([i, i + 1, i + 2]) as p from (select r, i, count(*) over (partition by r, a, b, c) as n from g) where n > 1),
rep as (select r, count(distinct p) as n_repeat_words from again group by r),
m as (select w.r, doc_id, source, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words from w left join rep using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, n_symbols * 5 > n_words as f1,
  word_chars < 2 * n_words or word_chars > 20 * n_words as f2, n_dup_lines * 10 > n_words as f3 from m),
x as (select *, base_failed or f1 or f2 or f3 as f4 from f),
long as (select source, k, cast(v as int) as v from (select source, unnest([1, 2, 3, 4]) as k, unnest([f1, f2, f3, f4]) as v from x)),
h as (select source, k, count(*)::double as n, sum(v)::double as s from long group by all),
p as (select k, sum(s) / sum(n) as m, count(*) as hosts, sum(n) as total, sum(n * n) as n2, sum(s * s / n) - sum(s) / sum(n) * sum(s) as between_ from h group by k),
sp as (select k, m, (between_ - (hosts - 1) * m * (1 - m)) / greatest(total - n2 / total, 1.0) as spread from p),
pr as (select k, m, greatest(1.0, least(10000.0, case when spread > 0 then m * (1 - m) / spread - 1 else 10000.0 end)) as st from sp),
rate as (select source, k, (s + m * st) / (n + st) as rate from h join pr using (k)),
wide as (select source, max(rate) filter (k = 1) as r1, max(rate) filter (k = 2) as r2, max(rate) filter (k = 3) as r3, max(rate) filter (k = 4) as r4 from rate group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (f1 and r1 >= 0.01 or f2 and r2 >= 0.01 or f3 and r3 >= 0.01 or r4 >= 0.6) as kept
from x join wide on x.source is not distinct from wide.source"""


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("leaks").alias("n_items"), F.transform("leaks", lambda m: m["item_id"]).alias("item_ids"),
                        F.array_max(F.transform("leaks", lambda m: m["edits"])).alias("most_edits"), (F.size("leaks") > 0).alias("contaminated"))


def unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Pieces.load(tokenizer_file("piece_bpe_32k.model"))
    encoded = pieces.encode_pieces(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    back = pieces.token_counts(pieces.decode_pieces(encoded, vocabulary), vocabulary)
    return back.select("doc_id", "n_tokens", "n_byte_tokens", F.xxhash64("ids").alias("ids_hash"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
                       F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    # functions of one parameter: a second one, even with a default, would be given the place in the array
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{pii.KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, F.sha2(pii.listing("base").cast("binary"), 256).alias("base_sha256"), pii.listing("spans").alias("spans"))


def noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", labelled.held_out("doc_id").alias("held_out"), "score", "predicted",
                         F.array_join(F.transform("sentences", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("sentences"))


def nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", labelled.held_out("doc_id").alias("held_out"), "score", "predicted")


def bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


EXACT_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))"""


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair_report(rows, conversations.damage(rows))


def block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(_table(spark, sf_dir, "embeddings")))


#: name -> (build, SQL or None)
ENTRIES = {
    "op1_kd_sharding": (kd_sharding, None),
    "op2_token_files": (token_files, None),
    "op3_bottom_k_dedup": (bottom_k_dedup, None),
    "op4_winnowed_lines": (winnowed_lines, WINNOWED_SQL),
    "op5_host_rules": (host_rules, HOST_SQL),
    "op6_benchmark_leaks": (benchmark_leaks, None),
    "op7_unigram_pieces": (unigram_pieces, None),
    "op8_disclosing_terms": (disclosing_terms, None),
    "op9_noisy_or_toxicity": (noisy_or_toxicity, None),
    "op10_nb_svm_quality": (nb_svm_quality, None),
    "op11_bloom_exact_dedup": (bloom_exact_dedup, EXACT_SQL),
    "op12_conversation_repair": (conversation_repair, None),
    "op13_block_whitening": (block_whitening, None),
}
