"""The registered query of each operator, with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, hamming_topk, language_id, mpeg_audio, packing, sentencepiece_bpe, setsketch, suffix_dedup, trie_dedup, url_rules, warc_zstd, weak_quality, whitening
from ._common import materialise, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 400)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


OP3_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from words),
classes as (select list_sort(s) as s, min(doc_id) as cls, len(any_value(s)) as n from sets group by list_sort(s)),
each as (select cls, n, unnest(s) as x from classes),
links as (
  select a.cls as a, b.cls as b from each a join each b on a.x = b.x and a.cls < b.cls and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by a.cls, b.cls, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select cls, cls from classes union select r.a, l.b from reach r join both_ways l on r.b = l.a),
label as (select a as cls, min(b) as component_id from reach group by a)
select t.doc_id, cast(len(t.s) as bigint) as n_shingles, case when len(t.s) = 0 then t.doc_id else l.component_id end as component_id,
  t.doc_id = case when len(t.s) = 0 then t.doc_id else l.component_id end as kept
from sets t left join classes c on list_sort(t.s) = c.s left join label l on l.cls = c.cls
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = warc_zstd.mark_revisits(table(spark, sf_dir, "pages"))
    archives = materialise(warc_zstd.write(marked), "warc")
    records = warc_zstd.read(archives)
    sound = records.withColumn("page_id", F.when(F.col("error").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("unsound record: "), "error")).cast("long")))
    return sound.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, cast(strlen(body) as bigint) as payload_bytes, sha256(body) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, by sign codes, among all others."""
    codes = hamming_topk.sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    found = hamming_topk.top_k(codes, codes.filter("id % 100 = 0"), k=10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP6_SQL = """
with codes as (
  select vec_id, cast(array_to_string(list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end), '') as bit) as code
  from embeddings where len(embedding) = 64),
pairs as (
  select q.vec_id as query_id, c.vec_id, cast(bit_count(xor(q.code, c.code)) as integer) as distance
  from codes q join codes c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, cast(rank as integer) as rank, vec_id, distance
from (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs) where rank <= 10
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    model = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.identify(docs, model, keep=("doc_id", "held_out"))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mpeg_audio.read(mpeg_audio.store(table(spark, sf_dir, "documents")), keep=("n_bytes",))
    # stored in units of a frame's ancillary data: what a reader finds is the padded payload
    unit = mpeg_audio.UNIT
    whole = F.length("payload") == F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / unit)) * unit
    lost = F.raise_error(F.concat(F.lit("payload of another length than stored: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = rows.withColumn("payload", F.when(whole, F.col("payload")).otherwise(lost.cast("binary")))
    return rows.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "samples", "hz", "frame_offsets",
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return weak_quality.classify(docs, weak_quality.fit(docs))


STATED_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), STATED_RULES)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP13_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
g as (select x, max(doc_id) as keep_id, count(*) as group_size from t group by x)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t.x) as text_sha256 from t join g on t.x = g.x
"""


def vector_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op12 what SQL can tell: the size of the fit list, each vector's exact distance and that the components explain falling shares."""
    rows = op12_whitening(spark, sf_dir)
    falling = F.max(F.struct(-F.col("component"), "explained"))["explained"] <= F.min(F.struct("component", "explained"))["explained"]
    return rows.groupBy("vec_id", "n", "deviation").agg(F.count("whitened").alias("components"), (falling & (F.max("identity_error") <= 1e-4)).alias("sound"))


DEVIATION_SQL = """
with e as (select vec_id, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
f as (select distinct x from e),
s as (select j, sum(v) as total from (select unnest(x) as v, generate_subscripts(x, 1) as j from f) group by j),
n as (select count(*) as n from f),
d as (select vec_id, sum((n * v - total) * (n * v - total)) as deviation from (select vec_id, unnest(x) as v, generate_subscripts(x, 1) as j from e) r join s on r.j = s.j, n group by vec_id)
select vec_id, n, cast(deviation as bigint) as deviation, cast(4 as bigint) as components, true as sound from d, n
"""


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op5 what SQL can tell: texts of plain words under single blanks come back as they are."""
    docs = table(spark, sf_dir, "documents")
    # no group that repeats: such a pattern would need a stack as deep as the text is long
    text = F.col("text")
    plain = docs.filter((text != "") & ~text.rlike("[^A-Za-z., ]") & ~text.contains("  ") & ~text.startswith(" ") & ~text.endswith(" ")).select("doc_id")
    rows = sentencepiece_bpe.encode(docs, tokenizer_path("piece_bpe_32k.model")).join(plain, "doc_id", "left_semi")
    return rows.select("doc_id", F.sha2("decoded", 256).alias("decoded_sha256"))


def undetermined_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7 what SQL can tell: which texts have no letter, by how many are held out at all."""
    rows = op7_language_id(spark, sf_dir)
    return rows.select("doc_id", (F.col("lang_pred") == "und").alias("undetermined"), ((F.col("score") >= 0) & (F.col("score") <= 1)).alias("in_range"))


def stored_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op8 what SQL can tell: lengths and digest of the payload that is read back."""
    return op8_mpeg_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "samples")


def stated_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op10 what SQL can tell: host, path and the stated rule with its verdict."""
    rows = op10_url_rules(spark, sf_dir)
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("stated"))


PAYLOAD_SQL = """
with t as (select doc_id, coalesce(text, '') as x, cast(strlen(coalesce(text, '')) as bigint) as n from documents),
p as (select doc_id, x, n, greatest(1, cast(ceil(n / 192.0) as bigint)) as units from t)
select doc_id, n as n_bytes, units * 192 as payload_bytes, sha256(x || repeat(' ', units * 192 - n)) as payload_sha256, 1152 * ((units + 1) // 2) as samples from p
"""
RULES_SQL = r"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(act, h, t) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f as (select page_id, arg_max(h || t, length(h || t)) as rule, arg_max(act, length(h || t)) as stated from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, t) group by page_id)
select p.page_id, host, path, rule, stated from p left join f on f.page_id = p.page_id
"""
COMPANION_SQL = {
    "decoded_texts": "select doc_id, sha256(text) as decoded_sha256 from documents where text <> '' and not regexp_matches(text, '[^A-Za-z., ]') and not contains(text, '  ') and not starts_with(text, ' ') and not ends_with(text, ' ')",
    "undetermined_texts": r"select doc_id, not coalesce(regexp_matches(text, '\p{L}'), false) as undetermined, true as in_range from documents",
    "stored_payloads": PAYLOAD_SQL,
    "stated_url_rules": RULES_SQL,
    "vector_deviations": DEVIATION_SQL,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_suffix_dedup, op3_near_dedup, op4_warc, op5_sentencepiece, op6_hamming_topk, op7_language_id, op8_mpeg_audio, op9_quality, op10_url_rules, op11_alignment, op12_whitening, op13_exact_dedup, pipeline, decoded_texts, undetermined_texts, stored_payloads, stated_url_rules, vector_deviations)
}
ORACLE_SQL: dict[str, str] = {"op3_near_dedup": OP3_SQL, "op4_warc": OP4_SQL, "op6_hamming_topk": OP6_SQL, "op13_exact_dedup": OP13_SQL} | COMPANION_SQL
