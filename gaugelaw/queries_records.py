"""Registered queries over records: audits, orphans, rankings, roll-ups, text and JSON extraction, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.contract import LEAK
from .plans.running import rank_within



def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counted(df: DataFrame, table: str, conditions: dict[tuple[str, str], Column]) -> DataFrame:
    """Rows (table_name, severity, code, n) of all conditions of a table from one scan."""
    one = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(code) for (_, code), c in conditions.items()))
    rows = F.array(*(F.struct(F.lit(table).alias("table_name"), F.lit(s).alias("severity"), F.lit(code).alias("code"), F.col(code).alias("n")) for s, code in conditions))
    return one.select(F.inline(rows))


def _sides(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    """Rows (k, n_left, n_right): how many rows of either table have each key, from one grouped union."""
    both = left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(F.col(other), F.lit(0), F.lit(1)))
    return both.groupBy("k").agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (table_name, severity, code, n): constraint queries over the tables, those that found something. A scan for each table, and one for each pair of keys."""
    li, orders, docs, labels = (_t(spark, sf_dir, n) for n in ("lineitem", "orders", "documents", "labels"))
    cust, part = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "part")
    bad = F.lit(False)
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    keys = li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("k"))
    left, right = F.col("n_left"), F.col("n_right")
    named = lambda df, **k: df.agg(*(F.sum(F.when(c, n)).alias(x) for x, (c, n) in k.items()))

    def pairs(a: DataFrame, ka: str, b: DataFrame, kb: str, rows: list[tuple[str, str, str, Column, Column]]) -> DataFrame:
        one = named(_sides(a, ka, b, kb), **{f"c{i}": (hit, n) for i, (_, _, _, hit, n) in enumerate(rows)})
        return one.select(F.inline(F.array(*(F.struct(F.lit(t).alias("table_name"), F.lit(s).alias("severity"), F.lit(code).alias("code"), F.coalesce(F.col(f"c{i}"), F.lit(0)).alias("n")) for i, (t, s, code, _, _) in enumerate(rows)))))

    found = [
        _counted(li, "lineitem", {("error", "CSV_NONFINITE"): bad, ("warn", "SAMPLING_MISMATCH"): F.expr("l_discount not between 0 and 0.1 or l_tax not between 0 and 0.08")}),
        _counted(keys, "lineitem", {("error", "DUP_KEY"): F.col("k") > 1}),
        _counted(docs, "documents", {("error", "EMPTY_SOURCE"): F.expr("text is null or trim(text) = ''"), ("error", "SAMPLE_COUNT_MISMATCH"): F.length("text") != F.col("n_chars")}),
        pairs(orders, "o_orderkey", li, "l_orderkey", [("orders", "warn", "MISSING_REFERENCE", right == 0, left), ("lineitem", "error", "ORPHAN_REFERENCE", left == 0, right)]),
        pairs(orders, "o_custkey", cust, "c_custkey", [("orders", "error", "ORPHAN_REFERENCE", right == 0, left)]),
        pairs(li, "l_partkey", part, "p_partkey", [("lineitem", "error", "ORPHAN_PART", right == 0, left)]),
        pairs(labels, "doc_id", docs, "doc_id", [("labels", "error", "ORPHAN_REFERENCE", right == 0, left), ("documents", "warn", "MISSING_LABEL", left == 0, right)]),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.filter("n > 0")


_FINDINGS_SQL = """f as (
select 'lineitem' as table_name, 'error' as severity, 'CSV_NONFINITE' as code, count(*) as n from lineitem where l_quantity is null or l_extendedprice is null or l_discount is null or l_tax is null or not (isfinite(l_quantity) and isfinite(l_extendedprice) and isfinite(l_discount) and isfinite(l_tax))
union all select 'lineitem', 'error', 'DUP_KEY', count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
union all select 'lineitem', 'warn', 'SAMPLING_MISMATCH', count(*) from lineitem where l_discount not between 0 and 0.1 or l_tax not between 0 and 0.08
union all select 'orders', 'warn', 'MISSING_REFERENCE', count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)
union all select 'lineitem', 'error', 'ORPHAN_REFERENCE', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)
union all select 'orders', 'error', 'ORPHAN_REFERENCE', count(*) from orders where o_custkey not in (select c_custkey from customer)
union all select 'lineitem', 'error', 'ORPHAN_PART', count(*) from lineitem where l_partkey not in (select p_partkey from part)
union all select 'labels', 'error', 'ORPHAN_REFERENCE', count(*) from labels where doc_id not in (select doc_id from documents)
union all select 'documents', 'warn', 'MISSING_LABEL', count(*) from documents where doc_id not in (select doc_id from labels)
union all select 'documents', 'error', 'EMPTY_SOURCE', count(*) from documents where text is null or trim(text) = ''
union all select 'documents', 'error', 'SAMPLE_COUNT_MISMATCH', count(*) from documents where length(text) <> n_chars)"""


def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("table_name").pivot("severity", ["error", "warn"]).agg(F.sum("n")).fillna(0)


def sampling_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of each numeric column, whether it is constant, and its values more than four standard deviations off, from two scans."""
    li = _t(spark, sf_dir, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    long = li.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in cols))))
    s = long.groupBy("name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    out = long.join(F.broadcast(s), "name").groupBy("name").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.count_if(F.abs(F.col("v") - F.col("m")) > 4 * F.col("sd")).alias("outliers"))  # four rows of ranges
    return out.select("name", "lo", "hi", (F.col("lo") == F.col("hi")).alias("constant"), "outliers")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids on one side only, of labels and pages, in both directions."""
    l, p = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct(), _t(spark, sf_dir, "pages").select(F.col("page_id").alias("id")).distinct()
    return l.join(p, "id", "left_anti").select(F.lit("label_without_page").alias("kind"), "id").union(p.join(l, "id", "left_anti").select(F.lit("page_without_label"), "id"))


def representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source and language one document: labelled ones first, then those of quality, then the smallest id."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    # a minimum instead of a ranked window: combined before the shuffle, whatever the group's size
    return docs.groupBy("source", "lang").agg(F.min_by("doc_id", F.struct(F.isnull("quality"), -F.coalesce("quality", F.lit(0)), "doc_id")).alias("doc_id"), F.count(F.lit(1)).alias("n"))


def scoring_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rates by language and overall."""
    j = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    r = j.rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return r.select(F.coalesce("lang", F.lit("overall")).alias("lang"), "n", "good", "toxic", F.round(F.col("good") / F.col("n"), 6).alias("rate"))


def dedup_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts made unique by their occurrence: name, name-2, ..."""
    p = _t(spark, sf_dir, "part")
    name = F.regexp_replace(F.concat_ws("_", "p_brand", "p_type"), r"[^A-Za-z0-9_]+", "-")
    return rank_within(p.select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], ["p_partkey"], "k").select("p_partkey", F.when(F.col("k") == 1, name).otherwise(F.concat_ws("-", name, "k")).alias("name"))


def sequence_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only numbers by day and type of event, of which none is left out: the one behind all in use (archive_names fills gaps)."""
    e = _t(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyyMMdd")
    return e.groupBy(day.alias("day"), "event_type").agg(F.count(F.lit(1)).alias("used")).select(F.concat_ws("_", "day", "event_type", F.lpad((F.col("used") + 1).cast("string"), 4, "0")).alias("next_name"), "used")


def leak_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address or text names an answer, by host."""
    p = _t(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    return p.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("url").rlike(LEAK)).alias("leaking"), F.count_if(F.col("url").rlike("^https?://")).alias("is_url"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of three or more digits claimed in documents, by how many documents repeat them."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\d{3,6})\b"), 1))).alias("claim"))
    return d.groupBy("claim").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the events' JSON properties and their number."""
    e = _t(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    return e.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"))


def first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the first turn with a question, its role, and the number of turns."""
    c = _t(spark, sf_dir, "conversations")
    asks = F.when(F.contains("text", F.lit("?")), F.struct("turn", "role"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min(asks).alias("f")).select("conv_id", "turns", F.col("f.turn").alias("first_turn"), F.col("f.role").alias("role"))


def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened figures of two snapshots of orders, as added, missing and changed paths."""
    o = _t(spark, sf_dir, "orders").withColumn("path", F.concat_ws("/", F.lit(""), "o_orderpriority", F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string")))
    a, b = (o.filter(F.col("o_orderstatus") == s).groupBy("path").agg(F.count(F.lit(1)).alias(n)) for s, n in (("F", "old"), ("O", "new")))
    j = a.join(b, "path", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    return j.select("path", "old", "new", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "missing").otherwise("changed").alias("kind"))


def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' digests against those of the benchmark's items: equal, missing or untracked by full outer join."""
    d = _t(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "source").groupBy("sha").agg(F.min("source").alias("source"))
    b = _t(spark, sf_dir, "benchmark").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "item_id").groupBy("sha").agg(F.min("item_id").alias("item_id"))
    j = d.join(b, "sha", "full_outer")
    return j.groupBy(F.when(F.col("source").isNull(), "missing").when(F.col("item_id").isNull(), "untracked").otherwise("equal").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def metric_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest symmetric relative difference of each vector's components from its label's means, and a status."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    # sums of the components are combined before the shuffle; vectors themselves are joined where they lie, with one row for each label
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    diff = F.zip_with("v", "mean", lambda x, m: F.abs(x - m) / F.greatest(F.abs(x), F.abs(m), F.lit(1e-300)))
    worst = e.join(means, "label").select("vec_id", F.array_max(diff).alias("w"))
    return worst.select("vec_id", F.round("w", 6).alias("max_diff"), F.when(F.col("w") <= 1e-9, "deterministic").when(F.col("w") > 1e-3, "stale").otherwise("agree").alias("status"))


def anonymous_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under derived ids, without what would give them away, and the nation by a lookup with a fallback."""
    s, n = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey, "left")
    return j.select(F.concat(F.lit("t-"), F.substring(F.sha1(F.col("s_suppkey").cast("string").cast("binary")), 1, 8)).alias("anon_id"), F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.round("s_acctbal", 2).alias("balance"))


def key_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations over ids: in both, on one side, in either."""
    d, l = _t(spark, sf_dir, "documents").select("doc_id").distinct(), _t(spark, sf_dir, "labels").select("doc_id").distinct()
    parts = {"either": d.union(l).distinct(), "both": d.intersect(l), "only_documents": d.subtract(l), "only_labels": l.subtract(d)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.union(row)
    return out


ORACLE_SQL = {
    "findings": f"with {_FINDINGS_SQL} select table_name, severity, code, cast(n as bigint) as n from f where n > 0",
    "findings_rollup": f"with {_FINDINGS_SQL} select table_name, cast(coalesce(sum(n) filter (severity = 'error'), 0) as bigint) as error, cast(coalesce(sum(n) filter (severity = 'warn'), 0) as bigint) as warn from f where n > 0 group by table_name",
    "sampling_ranges": "with l as (select unnest(['l_quantity','l_extendedprice','l_discount','l_tax']) as name, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as v from lineitem), s as (select name, min(v) as lo, max(v) as hi, avg(v) as m, stddev_pop(v) as sd from l group by name) select name, any_value(lo) as lo, any_value(hi) as hi, any_value(lo) = any_value(hi) as constant, cast(count(*) filter (abs(v - m) > 4 * sd) as bigint) as outliers from l join s using (name) group by name",
    "orphans": "select 'label_without_page' as kind, doc_id as id from (select distinct doc_id from labels) where doc_id not in (select page_id from pages) union all select 'page_without_label', page_id from pages where page_id not in (select doc_id from labels)",
    "representative": "select source, lang, doc_id, n from (select source, lang, doc_id, cast(count(*) over (partition by source, lang) as bigint) as n, row_number() over (partition by source, lang order by quality is null, coalesce(quality, 0) desc, doc_id) as k from documents left join labels using (doc_id)) where k = 1",
    "scoring_summary": "select coalesce(lang, 'overall') as lang, cast(count(*) as bigint) as n, cast(count(*) filter (quality = 1) as bigint) as good, cast(count(*) filter (toxic = 1) as bigint) as toxic, round(count(*) filter (quality = 1) / count(*), 6) as rate from labels join documents using (doc_id) group by rollup (lang)",
    "dedup_naming": "with k as (select p_partkey, regexp_replace(concat_ws('_', p_brand, p_type), '[^A-Za-z0-9_]+', '-', 'g') as name, row_number() over (partition by p_brand, p_type order by p_partkey) as k from part) select p_partkey, case when k = 1 then name else name || '-' || k end as name from k",
    "sequence_naming": "select concat_ws('_', strftime(ts, '%Y%m%d'), event_type, lpad(cast(count(*) + 1 as varchar), 4, '0')) as next_name, cast(count(*) as bigint) as used from events group by strftime(ts, '%Y%m%d'), event_type",
    "leak_names": "select regexp_extract(url, '://([^/?#]*)', 1) as host, cast(count(*) as bigint) as n, cast(count(*) filter (regexp_matches(url, '(?i)(reference|answer|ground[_-]?truth|ground|solution|truth|label|golden|expected[_-]?formula)')) as bigint) as leaking, cast(count(*) filter (regexp_matches(url, '^https?://')) as bigint) as is_url from pages group by 1",
    "claims": "with d as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '\\b(\\d{3,6})\\b', 1))) as claim from documents) select claim, cast(count(*) as bigint) as n, min(doc_id) as first_doc from d group by claim",
    "props_json": "with e as (select event_type, unnest(json_keys(props)) as key from events) select event_type, key, cast(count(*) as bigint) as n from e group by all",
    "first_failure": "select conv_id, cast(count(*) as bigint) as turns, min(turn) filter (contains(text, '?')) as first_turn, arg_min(role, (turn, role)) filter (contains(text, '?')) as role from conversations group by conv_id",
    "baseline_diff": "with o as (select o_orderstatus as s, concat_ws('/', '', o_orderpriority, year(o_orderdate), month(o_orderdate)) as path from orders), a as (select path, cast(count(*) as bigint) as old from o where s = 'F' group by path), b as (select path, cast(count(*) as bigint) as new from o where s = 'O' group by path) select path, old, new, case when old is null then 'added' when new is null then 'missing' else 'changed' end as kind from a full join b using (path) where old is distinct from new",
    "manifest_check": "with d as (select distinct sha256(coalesce(text, '')) as sha from documents), b as (select distinct sha256(coalesce(text, '')) as sha from benchmark) select case when d.sha is null then 'missing' when b.sha is null then 'untracked' else 'equal' end as status, cast(count(*) as bigint) as n from d full join b on d.sha = b.sha group by 1",
    "metric_diff": "with e as (select vec_id, label, unnest(range(64)) as i, cast(unnest(embedding) as double) as x from embeddings), m as (select label, i, avg(x) as m from e group by all), w as (select vec_id, max(abs(x - m) / greatest(abs(x), abs(m), 1e-300)) as w from e join m using (label, i) group by vec_id) select vec_id, round(w, 6) as max_diff, case when w <= 1e-9 then 'deterministic' when w > 1e-3 then 'stale' else 'agree' end as status from w",
    "anonymous_ids": "select 't-' || substr(sha1(cast(s_suppkey as varchar)), 1, 8) as anon_id, coalesce(n_name, 'unknown') as nation, round(s_acctbal, 2) as balance from supplier left join nation on s_nationkey = n_nationkey",
    "key_numbers": "select 'either' as name, cast(count(*) as bigint) as n from (select doc_id from documents union select doc_id from labels) union all select 'both', count(*) from (select doc_id from documents intersect select doc_id from labels) union all select 'only_documents', count(*) from (select doc_id from documents except select doc_id from labels) union all select 'only_labels', count(*) from (select doc_id from labels except select doc_id from documents)",
}
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
