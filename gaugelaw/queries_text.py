"""Registered queries over texts, labels, arrays and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.formula import compile_formula
from .operators import fit


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that pages mention against those that exist, by whether they look like a path of a repository."""
    pages, docs = _t(spark, sf_dir, "pages"), _t(spark, sf_dir, "benchmark")
    said = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1))).alias("path"))
    there = docs.select(F.explode(F.split("text", r"\s+")).alias("path")).distinct().withColumn("there", F.lit(True))
    return said.join(there, "path", "left").groupBy(F.when(F.col("there"), "found").otherwise("missing").alias("status"), text.is_repo_path(F.col("path")).alias("like_path")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"))


def hint_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that give a hint away, by role: any word of a list, and each of them."""
    words = ["solution", "answer", "email", "password", "que"]
    c = _t(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(text.names_any(F.col("text"), words)).alias("leaks"), *(F.count_if(text.names_any(F.col("text"), [w])).alias(f"n_{w}") for w in words))


def source_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct capitalised names in the documents of each source and language, and how often they stand there."""
    d = _t(spark, sf_dir, "documents").select("source", "lang", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]+tion)"), 1)).alias("name"))
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"), F.min("name").alias("first_name"))


def parameter_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters written as text and read back, labels, cells and scales in words."""
    p = _t(spark, sf_dir, "part")
    said = F.concat(F.lit(" size = "), "p_size", F.lit(",brand="), "p_brand", F.lit(",,=3,size="), F.col("p_size") + 1, F.lit(" , noise"))
    found = p.withColumn("m", text.pairs(said))
    scales = F.create_map(F.lit("q"), F.col("p_size"), F.lit("p"), F.length("p_type"))
    return found.select(
        "p_partkey", F.col("m")["size"].alias("size"), F.size("m").alias("n"), text.label(F.lit("scaling"), F.map_keys("m")).alias("label"), text.cell(F.when(F.col("p_size") > 5, F.col("p_brand"))).alias("brand_cell"),
        text.cell(F.when(F.col("p_size") != 7, F.col("p_size") > 25), "boolean").alias("large_cell"), text.describe_scales(scales).alias("scales"), F.array_join(F.array_sort(text.powers_in(F.concat(F.lit("y = a * size ** 2 + size^3 - brand**x + size ** 2 "), "p_brand"))), ",").alias("powers"),
    )


def rounded_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by customer to three significant digits, as a baseline holds them."""
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    return o.select("o_custkey", text.significant(F.round("s", 2), 3).alias("total"), text.significant(F.lit(1.0) / F.col("n"), 3).alias("inverse"))


def vector_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vector the largest step between neighbours, how often it rises, and how many components are positive."""
    e = _t(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    steps = text.steps_of(F.col("v"))
    return e.select("vec_id", F.round(F.array_max(F.transform(steps, lambda d: F.abs(d))), 6).alias("max_step"), F.size(F.filter(steps, lambda d: d > 0)).alias("rises"), F.size(F.filter("v", lambda x: x > 0)).alias("positive"))


def _uniform(tie: Column, at: int) -> Column:
    """A number in (0, 1) from eight digits of a hexadecimal hash."""
    return (F.conv(F.substring(tie, at, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def noise(rows: DataFrame, key: Column) -> DataFrame:
    """Rows (a, b, c, y) without a law: three numbers even over [1, 10] and a normal one, all from a hash of the key, so that they are the same again."""
    h = F.md5(key)
    bell = F.sqrt(-2 * F.ln(_uniform(h, 25))) * F.cos(2 * F.pi() * _uniform(F.md5(F.concat(h, F.lit("y"))), 1))
    return rows.select(*(1 + 9 * _uniform(h, 1 + 8 * i) for i in range(3)), bell).toDF("a", "b", "c", "y")


FAMILIES = {"line": ["a", "b", "c"], "product": ["a*b", "a*c", "b*c", "a*b*c"], "ratio": ["a/b", "b/c", "a*b/c"], "root": ["sqrt(a)", "sqrt(b*c)"]}


def noise_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of formulas fitted to noise: how many were tried and rejected, and the least residual, read from the reasons."""
    rows = noise(_t(spark, sf_dir, "events"), F.col("event_id").cast("string"))
    made = F.array(*(F.struct(F.lit(family).alias("family"), F.lit(f).alias("formula"), compile_formula(f, {v: F.col(v) for v in "abc"}).alias("f")) for family, fs in FAMILIES.items() for f in fs))
    k = fit.fit_scale(rows.select("y", F.inline(made)), F.col("f"), F.col("y"), ["family", "formula"])
    reason = F.concat(F.lit("RMSE/std(y) = "), F.round("fit_error", 4).cast("string"), F.when(F.col("fit_error") > 0.5, " > 0.5").otherwise(" ok"))
    told = k.select("family", reason.alias("reason"), (F.col("fit_error") > 0.5).alias("rejected"))
    residual = F.regexp_extract("reason", r"= ([0-9.]+)", 1).try_cast("double")
    return told.groupBy("family").agg(F.count(F.lit(1)).alias("attempted"), F.count_if("rejected").alias("rejected"), F.min(residual).alias("least_residual"))


def real_data_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power laws fitted to events' values, which follow none: residual and normalised error of finite predictions."""
    e = _t(spark, sf_dir, "events").select((F.col("user_id") + 1).cast("double").alias("u"), (F.hour("ts") + 1).cast("double").alias("h"), F.col("value").cast("double").alias("y"))
    formulas = ["u", "u**0.5", "u*h", "h**2", "u/h", "log(u-1)"]
    made = F.array(*(F.struct(F.lit(f).alias("formula"), compile_formula(f, {v: F.col(v) for v in "uh"}).alias("f")) for f in formulas))
    rows = e.select("y", F.inline(made))
    ok = ~F.isnan("f") & (F.abs("f") < float("inf"))
    k = rows.filter(ok).groupBy("formula").agg((F.sum(F.col("f") * F.col("y")) / F.sum(F.col("f") * F.col("f"))).alias("k"))
    j = rows.join(F.broadcast(k), "formula")  # one row for each formula
    d = F.when(ok, F.col("k") * F.col("f") - F.col("y"))
    a = j.groupBy("formula").agg(F.count(F.lit(1)).alias("n"), F.count(d).alias("n_finite"), F.sqrt(F.avg(d * d)).alias("rmse"), F.stddev_pop(F.when(ok, F.col("y"))).alias("sd"))
    enough = F.col("n_finite") >= F.greatest(F.lit(3), F.floor(F.col("n") / 2))
    return a.select("formula", "n", "n_finite", F.round(F.when(enough, F.col("rmse") / F.col("sd")).otherwise(float("inf")), 5).alias("normalized_rmse"), F.coalesce(enough & (F.col("rmse") / F.col("sd") <= 0.5), F.lit(False)).alias("accepted"))


_U = lambda h, i: f"(cast(concat('0x', substr({h}, {i}, 8)) as bigint) + 0.5) / 4294967296.0"
ORACLE_SQL = {
    "doc_mentions": """with s as (select page_id, unnest(list_distinct(regexp_extract_all(html, 'href="/([^"]*)"', 1))) as path from pages), b as (select distinct unnest(regexp_split_to_array(text, '\\s+')) as path from benchmark),
      j as (select s.path, b.path is not null as there, not regexp_matches(s.path, '^[a-z]+://|\\s|^$') and (regexp_matches(s.path, '\\.(py|md|json|csv|txt|yaml|html|svg)$') or regexp_matches(s.path, '^(src|tests|docs|examples)/')) as like_path from s left join b on b.path = s.path)
      select case when there then 'found' else 'missing' end as status, like_path, cast(count(*) as bigint) as n, cast(count(distinct path) as bigint) as paths from j group by all""",
    "hint_leaks": "with w as (select role, lower(text) as t from conversations) select role, cast(count(*) as bigint) as n, cast(count(*) filter (t like '%solution%' or t like '%answer%' or t like '%email%' or t like '%password%' or t like '%que%') as bigint) as leaks, "
    + ", ".join(f"cast(count(*) filter (contains(t, '{w}')) as bigint) as n_{w}" for w in ("solution", "answer", "email", "password", "que")) + " from w group by role",
    "source_text_counts": "with d as (select source, lang, unnest(regexp_extract_all(text, '([A-Z][a-z]+tion)', 1)) as name from documents) select source, lang, cast(count(*) as bigint) as n, cast(count(distinct name) as bigint) as names, min(name) as first_name from d group by all",
    "parameter_texts": """select p_partkey, cast(p_size + 1 as varchar) as size, 2 as n, 'scaling-brand-size' as label, case when p_size > 5 then p_brand else '' end as brand_cell, case when p_size = 7 then '' when p_size > 25 then '1' else '0' end as large_cell,
      'p x' || length(p_type) || ', q x' || p_size as scales, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all('y = a * size ** 2 + size^3 - brand**x + size ** 2 ' || p_brand, '([A-Za-z_]\\w*\\s*(?:\\*\\*|\\^)\\s*\\d+)', 1), lambda x: replace(regexp_replace(x, '\\s', '', 'g'), '^', '**')))), ',') as powers from part""",
    "rounded_figures": "with o as (select o_custkey, round(sum(o_totalprice), 2) as s, 1.0 / count(*) as i from orders group by o_custkey) select o_custkey, round(s * pow(10, 2 - floor(log10(s)))) / pow(10, 2 - floor(log10(s))) as total, round(i * pow(10, 2 - floor(log10(i)))) / pow(10, 2 - floor(log10(i))) as inverse from o",
    "vector_steps": "with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), d as (select vec_id, v, list_transform(range(2, len(v) + 1), lambda i: v[i] - v[i - 1]) as s from e) select vec_id, round(list_max(list_transform(s, lambda x: abs(x))), 6) as max_step, cast(len(list_filter(s, lambda x: x > 0)) as int) as rises, cast(len(list_filter(v, lambda x: x > 0)) as int) as positive from d",
    "noise_controls": f"""with h as (select md5(cast(event_id as varchar)) as h from events), n as (select 1 + 9 * {_U('h', 1)} as a, 1 + 9 * {_U('h', 9)} as b, 1 + 9 * {_U('h', 17)} as c, sqrt(-2 * ln({_U('h', 25)})) * cos(2 * pi() * {_U("md5(h || 'y')", 1)}) as y from h),
      f as (select y, unnest(['line','line','line','product','product','product','product','ratio','ratio','ratio','root','root']) as family, unnest(range(12)) as formula, unnest([a, b, c, a*b, a*c, b*c, a*b*c, a/b, b/c, a*b/c, sqrt(a), sqrt(b*c)]) as f from n),
      k as (select family, formula, sqrt(greatest(sum(y*y) - sum(f*y)/sum(f*f)*sum(f*y), 0) / count(*)) / stddev_pop(y) as e from f group by family, formula)
      select family, cast(count(*) as bigint) as attempted, cast(count(*) filter (e > 0.5) as bigint) as rejected, min(round(e, 4)) as least_residual from k group by family""",
    "real_data_control": """with e as (select cast(user_id + 1 as double) as u, cast(hour(ts) + 1 as double) as h, cast(value as double) as y from events), f as (select y, unnest(['u', 'u**0.5', 'u*h', 'h**2', 'u/h', 'log(u-1)']) as formula, unnest([u, sqrt(u), u*h, h*h, u/h, case when u > 1 then ln(u - 1) end]) as f from e),
      k as (select formula, sum(f*y)/sum(f*f) as k from f group by formula), a as (select formula, count(*) as n, count(f) as nf, sqrt(avg((k*f - y) * (k*f - y))) as rmse, stddev_pop(y) filter (f is not null) as sd from f join k using (formula) group by formula)
      select formula, cast(n as bigint) as n, cast(nf as bigint) as n_finite, round(case when nf >= greatest(3, floor(n / 2)) then rmse / sd else 'inf'::double end, 5) as normalized_rmse, nf >= greatest(3, floor(n / 2)) and rmse / sd <= 0.5 as accepted from a""",
}
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
