"""Registered queries of evidence, archive and scoring: orders stand for runs, their lines for checks and files, the gates' checks for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_gates
from .operators import evidence, gates
from .queries_law import SEG, columns, segments


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(what a manifest says, what stands there): a file for each line; some lines are new, gone or changed since."""
    li = _t(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("checks/"), "l_linenumber", F.lit(".json"))
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    text = lambda tax: F.sha2(F.concat_ws("|", "l_partkey", "l_suppkey", cents("l_quantity"), tax), 256)
    was = li.filter("l_returnflag <> 'N' or l_linenumber < 5").select(F.col("l_orderkey").alias("run_id"), path.alias("rel_path"), text(cents("l_tax")).alias("sha256"))
    now = li.filter("l_linestatus <> 'F' or l_linenumber <> 2").select(F.col("l_orderkey").alias("run_id"), path.alias("rel_path"), text(F.when(F.col("l_returnflag") == "R", cents("l_tax") + 1).otherwise(cents("l_tax"))).alias("sha256"))
    return was, now


_FILES_SQL = """f as (select l_orderkey as run_id, concat('checks/', l_linenumber, '.json') as rel_path, l_linenumber, l_returnflag, l_linestatus, concat_ws('|', l_partkey, l_suppkey, cast(round(l_quantity * 100) as bigint)) as head, cast(round(l_tax * 100) as bigint) as tax from lineitem),
was as (select run_id, rel_path, sha256(concat_ws('|', head, tax)) as d from f where l_returnflag <> 'N' or l_linenumber < 5),
now as (select run_id, rel_path, sha256(concat_ws('|', head, case when l_returnflag = 'R' then tax + 1 else tax end)) as d from f where l_linestatus <> 'F' or l_linenumber <> 2)"""


def tamper_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against their manifest: equal, mismatched, missing and untracked."""
    was, now = _files(spark, sf_dir)
    return evidence.manifest_status(was, now, ["run_id", "rel_path"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("runs"))


def run_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest for each run, of its files in order."""
    return evidence.run_digests(_files(spark, sf_dir)[1])


def overwritten_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose second writing differs from the first, by how many files each has."""
    was, now = (evidence.run_digests(f) for f in _files(spark, sf_dir))
    changed = evidence.overwritten(was, now, "run_id")
    return changed.join(now.select("run_id", "n_files"), "run_id").groupBy("n_files").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first_run"))


def archive_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, index and evidence that lack one another, in all four directions."""
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    runs = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("run_id"))
    index = o.filter("o_orderpriority <> '2-HIGH'").select(F.col("o_orderkey").alias("run_id"))
    held = li.filter("l_quantity > 25").select(F.col("l_orderkey").alias("run_id")).distinct()
    return evidence.orphans(runs, index, held, "run_id").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first_run"))


def prune_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence without an entry of the index: what may be removed, and what lies outside the archive's folder."""
    pages, labels = _t(spark, sf_dir, "pages"), _t(spark, sf_dir, "labels")
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "evidence/runs/../").when(F.col("page_id") % 3 == 1, "evidence/runs/").otherwise("elsewhere/"), F.col("page_id"))
    found = evidence.prunable(pages.select(F.col("page_id").alias("run_id"), path.alias("path")), labels.select(F.col("doc_id").alias("run_id")), "run_id", "path", "evidence/runs")
    return found.groupBy("removable").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's name from each event."""
    e = _t(spark, sf_dir, "events")
    head = F.when(F.col("event_id") % 7 == 0, "agent-").when(F.col("event_id") % 7 == 1, "cli-").when(F.col("event_id") % 7 == 2, "refcheck-").when(F.col("event_id") % 7 == 3, "reference-").when(F.col("event_id") % 7 == 4, "variant-").otherwise("")
    return e.select("event_id", "event_type", F.date_format("ts", "yyyyMMdd").alias("day"), F.concat(head, "event_type", F.lit("-"), "user_id", F.when(F.col("event_id") % 7 == 5, "-cand1").otherwise("")).alias("name"))


_NAMES_SQL = """names as (select event_id, event_type, strftime(ts, '%Y%m%d') as day, concat(case event_id % 7 when 0 then 'agent-' when 1 then 'cli-' when 2 then 'refcheck-' when 3 then 'reference-' when 4 then 'variant-' else '' end, event_type, '-', user_id, case when event_id % 7 = 5 then '-cand1' else '' end) as name from events),
kinds as (select *, case when starts_with(name, 'agent-') then 'agent' when starts_with(name, 'cli-') then 'cli' when regexp_matches(name, '^(refcheck-|variant-)') then 'fixture' when starts_with(name, 'reference-') then 'reference' when regexp_matches(name, '-cand[0-9]+$') then 'candidate' else 'unclassified' end as kind from names)"""


def source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by where they come from, how many the tool owns, and the first twenty names of none in order."""
    rows = _names(spark, sf_dir).withColumn("kind", evidence.classify(F.col("name")))
    counts = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(evidence.owned(F.col("name"))).alias("owned"))
    first = rows.filter("kind = 'unclassified'").select("name").distinct().orderBy("name").limit(20).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))  # twenty names
    return counts.join(F.broadcast(first)).select("kind", "n", "owned", F.when(F.col("kind") == "unclassified", F.col("names")).alias("names"))


def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers for new runs of a day: the smallest that no stored run has, in the order of their ids."""
    rows = _names(spark, sf_dir)
    used = rows.filter("event_id % 7 < 3").select("day", (F.col("event_id") % 50 + 1).alias("number"))
    given = evidence.allocate(rows.filter("event_id % 7 = 6").select("day", "event_id"), used, "day", ["event_id"])
    return given.select("event_id", F.concat_ws("_", "day", F.lpad(F.col("number").cast("string"), 4, "0")).alias("run_name"))


def duplicate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of checks that a report has more than once, by how often."""
    checks = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("name"))
    return evidence.duplicate_checks(checks).groupBy("name", "n").agg(F.count(F.lit(1)).alias("runs"), F.min("run_id").alias("first_run"))


def failed_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 120 runs with a failed check, and which failed."""
    checks = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat_ws("-", "l_linestatus", "l_returnflag").alias("name"), (F.col("l_discount") <= 0.08).alias("passed"))
    return evidence.failed_catalogue(checks)


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by arm: how many are bound to a session, how many match, and the distinct tasks with a match among agents' attempts."""
    e = _t(spark, sf_dir, "events").withColumns({"bound": F.get_json_object("props", "$.k0").isNotNull() | (F.col("event_id") % 4 > 0), "match": F.col("value") > 50})
    r = evidence.rates(e.filter("event_type <> 'view'"), ["event_type"], {"bound": F.col("bound"), "match": F.col("match")})
    tasks = e.groupBy("event_type").agg(F.count_distinct(F.when(F.col("match"), F.col("user_id"))).alias("tasks_matched"), F.count_distinct("user_id").alias("tasks"))
    return r.join(tasks, "event_type")


def latest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each task the formula that was written last."""
    o = _t(spark, sf_dir, "orders").withColumn("formula", F.concat("o_orderstatus", F.lit("*"), "o_orderpriority"))
    return evidence.latest(o, "o_custkey", "formula", ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("task_id"), "formula")


def resolved_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the task of each run is found: among its inputs, else among the tasks of its customer, else by its id."""
    o, c, li = (_t(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    inputs = li.filter("l_linenumber = 1 and l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("key")).agg(F.concat(F.lit("input:"), F.min("l_partkey").cast("string")).alias("at"))
    roots = c.filter("c_nationkey < 10").select(F.col("c_custkey").alias("key2"), F.concat(F.lit("root:"), "c_nationkey").alias("at2"))
    r = evidence.resolve(o, [(inputs, "o_orderkey", "at"), (roots, "o_custkey", "at2")], "task", F.concat(F.lit("id:"), F.col("o_orderpriority")))
    return r.groupBy("task").agg(F.count(F.lit(1)).alias("n"))


def best_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user whose events share most with an exported log, by number, id and type."""
    e = _t(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("seq"), F.col("event_id").alias("id"), F.col("event_type").alias("type"), "user_id")
    export = e.filter("type in ('click', 'purchase', 'view') and id % 3 = 0")
    return evidence.best_session(export, e, ["seq", "id", "type"], "user_id")


def discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of check passes of true formulas and stops of wrong ones, and what scale checks alone stop."""
    true = ["law", "scaled", "scaled_with_unit"]
    role = F.when(F.col("candidate").isin(true), "reference").otherwise("wrong")
    return evidence.discrimination(queries_gates._checks(spark, sf_dir).withColumn("role", role))


def failed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed candidates beside curated notes in their order; a note without a failed run, and a failure without a note, are told."""
    notes = spark.createDataFrame([(1, "unrelated", "fits nothing"), (2, "no_discount", "lacks a factor"), (3, "law", "should not fail"), (4, "cut_off", "syntax")], "place int, candidate string, note string")
    failed = gates.report(queries_gates._checks(spark, sf_dir)).filter("verdict = 'rejected'").select("candidate", "failed")
    j = failed.join(notes, "candidate", "full_outer")
    return j.select("candidate", F.coalesce("place", F.lit(0)).alias("place"), "failed", F.when(F.col("failed").isNull(), "no such failure").otherwise(F.coalesce("note", F.lit("no note"))).alias("note"))


def _formula_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tasks: one of five formulas, and units by the part's size, the target's among them or not."""
    formula = F.element_at(F.array(*map(F.lit, ("x/z", "x*z", "x + z", "k*x", "sqrt(x*x)"))), (F.substring("p_brand", 7, 1).cast("int") % 5 + 1))
    x = F.element_at(F.array(*map(F.lit, ("m", "kg*m/s^2", "s"))), (F.col("p_size") % 3 + 1).cast("int"))
    y = F.element_at(F.array(F.lit("m/s"), F.lit("m*s"), F.lit(None), F.lit("m")), (F.col("p_size") % 4 + 1).cast("int"))
    units = F.map_filter(F.create_map(F.lit("x"), x, F.lit("z"), F.lit("s"), F.lit("y"), y), lambda k, v: v.isNotNull())
    tasks = _t(spark, sf_dir, "part").select("p_partkey", formula.alias("formula"), units.alias("units"), F.array(F.lit("k")).alias("free"))
    return tasks.withColumn("free", F.when(F.col("formula").startswith("k"), F.col("free")))


def dimension_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tasks the dimension gate passes, fails and skips, by mode, and how many formulas these are."""
    return gates.dimension_gate(_formula_tasks(spark, sf_dir)).groupBy("mode", "passed").agg(F.sum("n").alias("tasks"), F.count(F.lit(1)).alias("formulas"))


REASONS = ("x*z", "k*(x+z)", "k*sin(x)", "k*x", "abs(x)", "x**-1", "x**2", "x**(1/0)", "x**1e400", "x*w", "-" * 1500 + "x", "x*(z", "c*x")


def dimension_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the dimension gate passes, fails or skips: parameters without and with a unit, unknown units, exponents, formulas that are none."""
    formula = F.element_at(F.array(*map(F.lit, REASONS)), (F.col("p_partkey") % len(REASONS) + 1).cast("int"))
    x = F.element_at(F.array(*map(F.lit, ("m", "s", "1", "parsec"))), (F.col("p_size") % 4 + 1).cast("int"))
    y = F.element_at(F.array(F.lit("m*s"), F.lit(None), F.lit("m"), F.lit("cubit"), F.lit("m^2")), (F.substring("p_brand", 7, 1).cast("int") % 5 + 1))
    units = F.create_map(F.lit("x"), x, F.lit("z"), F.lit("s"), F.lit("c"), F.lit("s"), F.lit("y"), y)
    units = F.when(F.col("p_retailprice") < 950, F.create_map().cast("map<string,string>")).otherwise(F.map_filter(units, lambda k, v: v.isNotNull()))
    free = F.when(formula.rlike("^[kc][*]"), F.array(F.substring(formula, 1, 1)))
    found = gates.dimension_gate(_t(spark, sf_dir, "part").select(formula.alias("formula"), units.alias("units"), free.alias("free")))
    return found.groupBy(F.when(F.length("formula") > 100, "deep").otherwise(F.col("formula")).alias("formula"), "mode", "passed", "reason").agg(F.sum("n").alias("tasks"))


def spoilt_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tasks after the unit of x is spoilt: where the gate, which passed strictly before, catches it and where it misses it."""
    tasks = _formula_tasks(spark, sf_dir)
    spoilt = F.transform_values("units", lambda k, v: F.when(k == "x", F.concat(F.lit("("), v, F.lit(")*m"))).otherwise(v))
    told = lambda u: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(u))))
    both = tasks.select("p_partkey", "formula", "free", told("units").alias("was"), told(spoilt).alias("is"))

    def judged(units: Column, name: str) -> DataFrame:
        # one row for each formula with other units
        rows = gates.dimension_gate(tasks.select("formula", units.alias("units"), "free"))
        return F.broadcast(rows.select("formula", F.col("units").alias(name), F.col("mode").alias(f"{name}_mode"), F.col("passed").alias(f"{name}_passed")))

    j = both.join(judged(F.col("units"), "was"), ["formula", "was"]).join(judged(spoilt, "is"), ["formula", "is"])
    outcome = F.when(~F.col("was_passed") | (F.col("was_mode") != "strict"), "no answer").when(F.col("is_passed"), "missed").otherwise("caught")
    return j.groupBy("formula", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_task"))


def _dimension_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tasks with a formula, of which some have a parameter without a unit and some no unit of the target."""
    kind = F.col("p_size") % 3
    units = F.when(kind == 0, F.create_map(F.lit("x"), F.lit("m"), F.lit("y"), F.lit("m"))).otherwise(F.create_map(F.lit("x"), F.lit("m")))
    units = F.when(kind == 1, F.create_map(F.lit("x"), F.lit("m"), F.lit("y"), F.lit("m/s"))).otherwise(units)
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_id"), "p_brand", F.when(kind == 1, "k*x").otherwise("x").alias("formula"), units.alias("units"), F.when(kind == 1, F.array(F.lit("k"))).alias("free"))


def uncovered_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose dimensions are not strictly checked and that no structural check covers either, by mode."""
    tasks = _dimension_tasks(spark, sf_dir)
    modes = gates.dimension_gate(tasks).select("formula", F.col("units").alias("told"), "mode")
    told = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("units"))))
    # one row for each formula with other units
    judged = tasks.withColumn("told", told).join(F.broadcast(modes), ["formula", "told"])
    covered = _t(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("task_id")).distinct()
    left = judged.filter("mode <> 'strict'").join(covered, "task_id", "left_anti")
    return left.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.min("task_id").alias("first_task"))


def review_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with the number of their checks beside their metadata and their answers, for those that have all three."""
    specs = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("task_id")).agg(F.count(F.lit(1)).alias("checks"), F.count_distinct("l_returnflag").alias("kinds"))
    answers = _t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("task_id")).agg(F.round(F.max("o_totalprice"), 2).alias("answer"))
    return _dimension_tasks(spark, sf_dir).select("task_id", "p_brand", "formula").join(specs, "task_id").join(answers, "task_id")


ATTACKS = {
    "constant": "100000+0*p", "copies_a_column": "p", "wrong_sign": "-(p*(1-d)*(1+t))", "swapped_roles": "d*(1-p)*(1+t)", "doubled": "2*p*(1-d)*(1+t)", "undefined": "log(0-p)", "infinite": "p/(d-d)",
    "huge_power": "p**9", "hidden_term": "p*(1-d)*(1+t)+p*0.2*sin(q)", "true_law": "p*(1-d)*(1+t)", "injected": "__import__('os').getcwd()", "attribute": "p.real", "compared": "p if p>0 else d", "text": "'p'",
}


def adversarial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attacks on the gates: what each is, what stops it first, and its error on held-out rows; only the true law may pass."""
    candidates = {k: gates.Candidate(f) for k, f in ATTACKS.items()}
    found, sound = gates.metadata_checks(spark, candidates, list("pdtq"), {}, dimension=False)
    errors = gates.error_checks(segments(spark, sf_dir), {k: candidates[k] for k in sound}, None, columns("pdtq"), "y", 0.02, 0.03)
    rows = found.unionByName(errors)
    v = gates.report(rows).select("candidate", "verdict", "first_failed")
    return v.join(rows.filter("name = 'holdout'").select("candidate", F.round("value", 6).alias("error")), "candidate", "left")


def set_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks, checks and mean checks of each layer, and ids that differ in capitals only."""
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    per = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("checks"))
    j = o.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("checks", F.coalesce("checks", F.lit(0)))
    a = j.groupBy(F.col("o_orderpriority").alias("layer")).agg(F.count(F.lit(1)).alias("tasks"), F.sum("checks").alias("checks"), F.round(F.avg("checks"), 6).alias("mean_checks"))
    ids = o.select(F.col("o_orderpriority").alias("layer"), F.concat(F.when(F.col("o_orderstatus") == "F", "T").otherwise("t"), (F.col("o_orderkey") / 64).cast("long").cast("string")).alias("id"))
    alike = ids.groupBy("layer", F.lower("id").alias("k")).agg(F.count_distinct("id").alias("n")).filter("n > 1").groupBy("layer").agg(F.count(F.lit(1)).alias("alike"))
    return a.join(alike, "layer", "left").withColumn("alike", F.coalesce("alike", F.lit(0)))


_CHK = queries_gates._GATES
ORACLE_SQL = {
    "tamper_check": f"with {_FILES_SQL}, j as (select run_id, case when now.d is null then 'missing' when was.d is null then 'untracked' when was.d = now.d then 'equal' else 'mismatched' end as status from was full join now using (run_id, rel_path)) select status, cast(count(*) as bigint) as n, cast(count(distinct run_id) as bigint) as runs from j group by status",
    "run_digests": f"with {_FILES_SQL} select run_id, cast(count(*) as bigint) as n_files, sha256(string_agg(rel_path || ' ' || d, chr(10) order by rel_path || ' ' || d)) as digest from now group by run_id",
    "overwritten_runs": f"""with {_FILES_SQL}, a as (select run_id, sha256(string_agg(rel_path || ' ' || d, chr(10) order by rel_path || ' ' || d)) as d from was group by run_id), b as (select run_id, count(*) as n_files, sha256(string_agg(rel_path || ' ' || d, chr(10) order by rel_path || ' ' || d)) as d from now group by run_id)
      select cast(n_files as bigint) as n_files, cast(count(*) as bigint) as n, min(run_id) as first_run from a join b using (run_id) where a.d <> b.d group by n_files""",
    "archive_orphans": """with r as (select o_orderkey as id from orders where o_orderstatus <> 'P'), i as (select o_orderkey as id from orders where o_orderpriority <> '2-HIGH'), e as (select distinct l_orderkey as id from lineitem where l_quantity > 25),
      x as (select 'run_not_indexed' as kind, id from r where id not in (select id from i) union all select 'indexed_without_run', id from i where id not in (select id from r) union all select 'indexed_without_evidence', id from i where id not in (select id from e) union all select 'evidence_not_indexed', id from e where id not in (select id from i))
      select kind, cast(count(*) as bigint) as n, min(id) as first_run from x group by kind""",
    "prune_evidence": "with p as (select page_id, concat(case page_id % 3 when 0 then 'evidence/runs/../' when 1 then 'evidence/runs/' else 'elsewhere/' end, page_id) as path from pages where page_id not in (select doc_id from labels)) select starts_with(path, 'evidence/runs/') and not contains(path, '/../') as removable, cast(count(*) as bigint) as n, min(path) as first_path from p group by 1",
    "source_histogram": f"with {_NAMES_SQL}, f as (select string_agg(name, ',' order by name) as names from (select distinct name from kinds where kind = 'unclassified' order by name limit 20)) select kind, cast(count(*) as bigint) as n, cast(count(*) filter (kind in ('fixture', 'candidate') or regexp_matches(name, '-cand[0-9]+$')) as bigint) as owned, case when kind = 'unclassified' then any_value(names) end as names from kinds, f group by kind",
    "archive_names": f"""with {_NAMES_SQL}, u as (select distinct day, event_id % 50 + 1 as number from names where event_id % 7 < 3), w as (select day, event_id, row_number() over (partition by day order by event_id) as k from names where event_id % 7 = 6),
      top as (select day, max(k) as k from w group by day), free as (select day, n, row_number() over (partition by day order by n) as k from (select day, unnest(range(1, k + 52)) as n from top) c where not exists (select 1 from u where u.day = c.day and u.number = c.n))
      select event_id, concat_ws('_', day, lpad(cast(n as varchar), 4, '0')) as run_name from w join free using (day, k)""",
    "duplicate_checks": "with d as (select l_orderkey, l_returnflag as name, count(*) as n from lineitem group by all having count(*) > 1) select name, cast(n as bigint) as n, cast(count(*) as bigint) as runs, min(l_orderkey) as first_run from d group by name, n",
    "failed_catalogue": "select l_orderkey as run_id, string_agg(distinct concat_ws('-', l_linestatus, l_returnflag), ',' order by concat_ws('-', l_linestatus, l_returnflag)) as failed from lineitem where l_discount > 0.08 group by l_orderkey order by l_orderkey limit 120",
    "provenance": """with e as (select *, json_extract(props, '$.k0') is not null or event_id % 4 > 0 as bound, value > 50 as hit from events),
      r as (select event_type, count(*) as n, count(*) filter (bound) as bound, count(*) filter (hit) as match from e where event_type <> 'view' group by event_type), t as (select event_type, count(distinct user_id) filter (hit) as tasks_matched, count(distinct user_id) as tasks from e group by event_type)
      select event_type, cast(n as bigint) as n, cast(bound as bigint) as bound, round(bound / n, 6) as bound_rate, cast(match as bigint) as match, round(match / n, 6) as match_rate, cast(tasks_matched as bigint) as tasks_matched, cast(tasks as bigint) as tasks from r join t using (event_type)""",
    "latest_candidate": "select o_custkey as task_id, arg_max(o_orderstatus || '*' || o_orderpriority, (o_orderdate, o_orderkey)) as formula from orders group by o_custkey",
    "resolved_tasks": """with i as (select l_orderkey as k, min(l_partkey) as p from lineitem where l_linenumber = 1 and l_returnflag = 'R' group by l_orderkey), r as (select c_custkey as k, c_nationkey as n from customer where c_nationkey < 10)
      select coalesce('input:' || i.p, 'root:' || r.n, 'id:' || o_orderpriority) as task, cast(count(*) as bigint) as n from orders left join i on i.k = o_orderkey left join r on r.k = o_custkey group by 1""",
    "best_session": "select user_id, cast(count(*) filter (event_type in ('click', 'purchase', 'view') and event_id % 3 = 0) as bigint) as matched, cast(count(*) as bigint) as of from events group by user_id order by matched desc, user_id limit 1",
    "discrimination": f"""{_CHK}, r as (select *, case when candidate in ('law', 'scaled', 'scaled_with_unit') then 'reference' else 'wrong' end as role from chk),
      one as (select case when name like 'scale-%' then regexp_replace(substr(name, 7), '-[0-9]+$', '') else name end as judge, role, candidate, bool_and(passed) as ok from r group by all),
      every as (select role, candidate, bool_and(passed) as a, coalesce(bool_and(passed) filter (name not like 'scale-%'), true) as n from r group by all),
      x as (select judge, role, ok from one union all select '(all gates)', role, a from every union all select '(numeric gates)', role, n from every union all select '(scale gates alone)', role, not (n and not a) from every)
      select judge, cast(count(*) filter (role = 'reference') as bigint) as n_reference, cast(count(*) filter (role = 'reference' and ok) as bigint) as passed_reference, cast(count(*) filter (role = 'wrong') as bigint) as n_wrong, cast(count(*) filter (role = 'wrong' and not ok) as bigint) as failed_wrong from x group by judge""",
    "failed_candidates": f"""{_CHK}, f as (select candidate, string_agg(name, ',' order by ord) filter (not passed) as failed from chk group by candidate having not bool_and(passed)), n(place, candidate, note) as (values (1, 'unrelated', 'fits nothing'), (2, 'no_discount', 'lacks a factor'), (3, 'law', 'should not fail'), (4, 'cut_off', 'syntax'))
      select candidate, coalesce(place, 0) as place, failed, case when failed is null then 'no such failure' else coalesce(note, 'no note') end as note from f full join n using (candidate)""",
    "set_layers": """with per as (select l_orderkey, count(*) as c from lineitem group by l_orderkey), j as (select o_orderpriority as layer, coalesce(c, 0) as c from orders left join per on o_orderkey = l_orderkey),
      ids as (select o_orderpriority as layer, concat(case when o_orderstatus = 'F' then 'T' else 't' end, o_orderkey // 64) as id from orders), alike as (select layer, count(*) as alike from (select layer, lower(id) as k from ids group by all having count(distinct id) > 1) group by layer)
      select layer, cast(count(*) as bigint) as tasks, cast(sum(c) as bigint) as checks, round(avg(c), 6) as mean_checks, cast(coalesce(any_value(alike), 0) as bigint) as alike from j left join alike using (layer) group by layer""",
    "spoilt_units": """with t as (select p_partkey, cast(substr(p_brand, 7, 1) as int) % 5 + 1 as f, p_size % 3 as x, p_size % 4 as y from part),
      xs(x, m, kg, s) as (values (0, 1, 0, 0), (1, 1, 1, -2), (2, 0, 0, 1)), ys(y, ym, ykg, ys) as (values (0, 1, 0, -1), (1, 1, 0, 1), (3, 1, 0, 0)),
      d as (select p_partkey, f, ym, m, kg, s + case f when 1 then -1 when 2 then 1 else 0 end as s, m = 0 and kg = 0 and s = 1 as like_z, m = -1 and kg = 0 and s = 1 as like_z_after, ykg, ys from t join xs on xs.x = t.x left join ys on ys.y = t.y),
      j as (select *, ym is not null and f <> 4 and (f <> 3 or like_z) and m = ym and kg = ykg and s = ys as was, (f <> 3 or like_z_after) and m + 1 = ym and kg = ykg and s = ys as now from d)
      select ['x/z', 'x*z', 'x + z', 'k*x', 'sqrt(x*x)'][f] as formula, case when not was then 'no answer' when now then 'missed' else 'caught' end as outcome, cast(count(*) as bigint) as n, min(p_partkey) as first_task from j group by all""",
    "uncovered_tasks": """with t as (select p_partkey as task_id, case p_size % 3 when 0 then 'strict' when 1 then 'structural' else 'skipped' end as mode from part), c as (select l_partkey from lineitem where l_quantity > 48)
      select mode, cast(count(*) as bigint) as n, min(task_id) as first_task from t where mode <> 'strict' and task_id not in (select l_partkey from c) group by mode""",
    "review_table": """select p_partkey as task_id, p_brand, case when p_size % 3 = 1 then 'k*x' else 'x' end as formula, checks, kinds, answer from part join (select l_partkey, cast(count(*) as bigint) as checks, cast(count(distinct l_returnflag) as bigint) as kinds from lineitem group by l_partkey) s on l_partkey = p_partkey
      join (select o_custkey, round(max(o_totalprice), 2) as answer from orders where o_orderstatus = 'P' group by o_custkey) a on o_custkey = p_partkey""",
    "adversarial": f"""{SEG}, a(candidate, formula) as (values """ + ", ".join("('{}', '{}')".format(k, f.replace("'", "''")) for k, f in ATTACKS.items()) + """),
      bad as (select candidate from a where regexp_matches(formula, '__|''|[a-z][.][a-z]| if ')),
      x as (select candidate, segment, y, case candidate when 'constant' then 100000.0 when 'copies_a_column' then p when 'wrong_sign' then -(p*(1-d)*(1+t)) when 'swapped_roles' then d*(1-p)*(1+t) when 'doubled' then 2*p*(1-d)*(1+t) when 'huge_power' then pow(p, 9)
        when 'hidden_term' then p*(1-d)*(1+t)+p*0.2*sin(q) when 'true_law' then p*(1-d)*(1+t) end as v from seg, a where segment <> 'train' and candidate not in (select candidate from bad)),
      g as (select candidate, segment, case when count(v) >= greatest(3, floor(count(*) / 2)) then quantile_cont(abs(v - y) / abs(y), 0.5) else 'inf'::double end as e, 1 - count(v) / count(*) as nonfinite from x group by all),
      c as (select candidate, segment as name, e <= case segment when 'holdout' then 0.02 else 0.03 end and (segment = 'holdout' or nonfinite < 0.1) as ok, case segment when 'holdout' then 4 else 5 end as ord, e from g union all select candidate, 'expression', false, 2, null from bad)
      select candidate, case when bool_and(ok) then 'accepted' else 'rejected' end as verdict, min_by(name, ord) filter (not ok) as first_failed, round(max(e) filter (name = 'holdout'), 6) as error from c group by candidate""",
    # each formula as its exponents of m and s where x is so, what it needs of x, and whether it is a formula at all
    "dimension_reasons": """with t as (select p_partkey % 13 as f, p_size % 4 as x, cast(substr(p_brand, 7, 1) as int) % 5 as y, p_retailprice < 950 as bare from part),
      g as (select *, case when bare then 'no-units' when x = 3 then 'unknown-unit' when f in (9, 10, 11) then 'unsafe-expression' when f in (5, 7, 8) or (f = 1 and x <> 1) or (f in (2, 4) and x <> 2) then 'dimension-mismatch'
          when y in (1, 3) then 'unknown-y-unit' when f in (1, 2, 3) then 'free-parameters' end as reason,
        case f when 6 then 2 when 4 then 0 else 1 end * case x when 0 then 1 else 0 end as m, case f when 6 then 2 when 4 then 0 else 1 end * case x when 1 then 1 else 0 end + case when f in (0, 12) then 1 else 0 end as s,
        case y when 4 then 2 else 1 end as ym, case y when 0 then 1 else 0 end as ys from t),
      r as (select f, coalesce(reason, case when m = ym and s = ys then 'consistent' else 'dimension-mismatch' end) as reason from g)
      select ['x*z', 'k*(x+z)', 'k*sin(x)', 'k*x', 'abs(x)', 'x**-1', 'x**2', 'x**(1/0)', 'x**1e400', 'x*w', 'deep', 'x*(z', 'c*x'][f + 1] as formula, case when reason in ('no-units', 'unknown-unit', 'unknown-y-unit') then 'skipped' when reason = 'free-parameters' then 'structural' else 'strict' end as mode,
        reason not in ('unsafe-expression', 'dimension-mismatch') as passed, reason, cast(count(*) as bigint) as tasks from r group by all""",
    "dimension_gate": """with t as (select cast(substr(p_brand, 7, 1) as int) % 5 + 1 as f, p_size % 3 as x, p_size % 4 as y from part),
      xs(x, m, kg, s) as (values (0, 1, 0, 0), (1, 1, 1, -2), (2, 0, 0, 1)), ys(y, ym, ykg, ys) as (values (0, 1, 0, -1), (1, 1, 0, 1), (3, 1, 0, 0)),
      d as (select f, t.x, t.y, m, kg, s + case f when 1 then -1 when 2 then 1 else 0 end as s, f <> 3 or (m = 0 and kg = 0 and s = 1) as adds, ym, ykg, ys from t join xs on xs.x = t.x left join ys on ys.y = t.y),
      j as (select f, x, y, case when not adds then 'strict' when ym is null then 'skipped' when f = 4 then 'structural' else 'strict' end as mode, adds and (ym is null or f = 4 or (m = ym and kg = ykg and s = ys)) as passed from d)
      select mode, passed, cast(count(*) as bigint) as tasks, cast(count(distinct (f, x, y)) as bigint) as formulas from j group by mode, passed""",
}
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
