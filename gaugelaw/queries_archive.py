"""Registered queries over sources, sinks, rechecks, streams and fits by iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.nonlinear import fit_nonlinear
from .queries_law import SEG, columns, segments
from .queries_series import BANDS_SQL, STEPS_SQL, bands, step_sums
from .sources import readers, sinks
from .streaming import archive as streams


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def import_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as text under a separator that the reader has to find, with the price as target."""
    path = f"{sinks.shared_folder(spark, 'import')}.txt"
    sinks.write_import(_t(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", path, ";")
    rows = readers.numeric(readers.read_table(spark, path), ["y", "p_partkey", "p_size"])
    return rows.groupBy("p_size").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 2).alias("y_sum"), F.max("p_partkey").alias("last_key"))


def import_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON lines and back."""
    path = f"{sinks.shared_folder(spark, 'records')}.jsonl"
    _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.json(path)
    rows = readers.read_table(spark, path)
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderkey").alias("last_key"))


def sealed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the open and in the sealed place after a split."""
    folder = sinks.shared_folder(spark, "sealed")
    places = {"open": f"{folder}/task", "sealed": f"{folder}/sealed"}
    sinks.seal(segments(spark, sf_dir).select("p", "d", "t", "y", "segment"), places["open"], places["sealed"])
    held = [spark.read.parquet(path).withColumn("place", F.lit(place)) for place, path in places.items()]
    return held[0].unionByName(held[1]).groupBy("place", "segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("p"), 2).alias("p_min"), F.round(F.max("p"), 2).alias("p_max"))


def archive_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three visits to an archive: finished orders, those again, then all orders."""
    path, orders = sinks.shared_folder(spark, "archive"), _t(spark, sf_dir, "orders")
    done = orders.filter("o_orderstatus = 'F'")
    for records in (done, done, orders):
        held = sinks.archive(spark, records, "o_orderkey", path)
    return held.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def recheck_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored totals of orders against those recomputed from their lines: statuses, their share and the share that agrees."""
    worth = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    again = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(worth).alias("again"))
    j = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(again, "o_orderkey", "left")
    diff = F.abs(F.col("again") - F.col("o_totalprice")) / F.greatest(F.abs("again"), F.abs("o_totalprice"), F.lit(1e-300))
    status = F.when(F.col("again").isNull(), "out_of_scope").when(diff <= 1e-9, "deterministic").when(diff <= 1e-3, "agree").when(diff <= 0.1, "stale").otherwise("disagree")
    tally = j.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(diff), 6).alias("max_diff"))
    scope = tally.agg(F.sum("n").alias("all_n"), F.sum(F.when(F.col("status") != "out_of_scope", F.col("n"))).alias("in_scope"))
    # one row, the sums of at most five statuses
    return tally.join(F.broadcast(scope)).select("status", "n", "max_diff", F.round(F.col("n") / F.col("all_n"), 6).alias("share"), F.when(F.col("status") != "out_of_scope", F.round(F.col("n") / F.col("in_scope"), 6)).alias("rate"))


def grid_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange and loss rates that are not negative: a grid of 41 by 41 over [0, 1], then three finer ones around the best."""
    best = step_sums(bands(spark, sf_dir)).withColumns({"kd": F.lit(0.5), "kl": F.lit(0.5)})
    at = lambda k, width: F.transform(F.sequence(F.lit(-20), F.lit(20)), lambda i: F.greatest(F.col(k) + i * (width / 20), F.lit(0.0)))
    sse = F.expr("sbb - 2*kd*s1b - 2*kl*s2b + kd*kd*s11 + 2*kd*kl*s12 + kl*kl*s22")
    sums = ["s11", "s12", "s22", "s1b", "s2b", "sbb", "n"]
    for level in range(4):
        width = 0.5 / 3**level
        grid = best.withColumn("kd", F.explode(at("kd", width))).withColumn("kl", F.explode(at("kl", width)))
        best = grid.groupBy(*sums).agg(F.min_by(F.struct("kd", "kl"), F.struct(F.round(sse, 6), "kd", "kl")).alias("b")).select(*sums, "b.kd", "b.kl")
    return best.select(F.round("kd", 6).alias("kd"), F.round("kl", 6).alias("kl"), F.round(F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("n")), 5).alias("rmse"))


def power_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor and exponents of the price law, from several starts, on the training rows."""
    seg = segments(spark, sf_dir).filter("segment = 'train'")
    found, cost = fit_nonlinear(seg, "a*p**b*(1-d)**c", columns("pd"), F.col("y"), {"a": (0.5, 2.0), "b": (0.9, 1.1), "c": (0.0, 2.0)})
    return spark.createDataFrame([(n, round(v, 4)) for n, v in [*found.items(), ("cost", cost)]], "parameter string, value double")


def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events through a stream that stores each once."""
    held = streams.archive_stream(streams.read_stream(spark, f"{sf_dir}/events.parquet*"), "event_id", "ts")
    return held.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("event_id").alias("last_id"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, as a stream emits them once an hour is closed."""
    w = streams.closed_windows(streams.read_stream(spark, f"{sf_dir}/events.parquet*"), "event_type", "value", "ts")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


def _grid_sql() -> str:
    sse = "round(sbb - 2*kd*s1b - 2*kl*s2b + kd*kd*s11 + 2*kd*kl*s12 + kl*kl*s22, 6)"
    levels, was = [], "(select 0.5::double as kd, 0.5::double as kl)"
    for level in range(4):
        step = f"({0.5 / 3**level!r}::double / 20)"
        levels.append(f"g{level} as (select kd, kl from (select greatest(b.kd + i * {step}, 0) as kd, greatest(b.kl + j * {step}, 0) as kl from {was} b, range(-20, 21) r(i), range(-20, 21) s(j)), q order by {sse}, kd, kl limit 1)")
        was = f"g{level}"
    return f"with {BANDS_SQL}, {STEPS_SQL}, {', '.join(levels)} select round(kd, 6) as kd, round(kl, 6) as kl, round(sqrt(greatest({sse}, 0) / n), 5) as rmse from g3, q"


ORACLE_SQL = {
    "import_delimited": "select cast(p_size as double) as p_size, cast(count(*) as bigint) as n, round(sum(p_retailprice), 2) as y_sum, cast(max(p_partkey) as double) as last_key from part group by p_size",
    "import_records": "select o_orderstatus, cast(count(*) as bigint) as n, round(sum(o_totalprice), 2) as total, max(o_orderkey) as last_key from orders group by o_orderstatus",
    "sealed_split": f"{SEG} select case segment when 'train' then 'open' else 'sealed' end as place, segment, cast(count(*) as bigint) as n, round(min(p), 2) as p_min, round(max(p), 2) as p_max from seg group by segment",
    "archive_batches": "select cast(1 as integer) as batch, cast(count(*) as bigint) as n, min(o_orderkey) as first_key, max(o_orderkey) as last_key from orders where o_orderstatus = 'F' union all select 2, count(*), min(o_orderkey), max(o_orderkey) from orders where o_orderstatus <> 'F'",
    "recheck_totals": """with a as (select l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as again from lineitem group by l_orderkey),
      d as (select again, abs(again - o_totalprice) / greatest(abs(again), abs(o_totalprice), 1e-300) as diff from orders left join a on l_orderkey = o_orderkey),
      s as (select case when again is null then 'out_of_scope' when diff <= 1e-9 then 'deterministic' when diff <= 1e-3 then 'agree' when diff <= 0.1 then 'stale' else 'disagree' end as status, case when again is not null then diff end as diff from d),
      t as (select status, cast(count(*) as bigint) as n, round(max(diff), 6) as max_diff from s group by status)
      select status, n, max_diff, round(n / (sum(n) over ()), 6) as share, case when status <> 'out_of_scope' then round(n / (sum(n) filter (status <> 'out_of_scope') over ()), 6) end as rate from t""",
    "grid_identify": _grid_sql(),
    "stream_archive": "select event_type, cast(count(*) as bigint) as n, round(sum(value), 2) as total, max(event_id) as last_id from events group by event_type",
    "stream_windows": "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H') as hour, event_type, cast(count(*) as bigint) as n, round(sum(value), 2) as total from events where time_bucket(interval 1 hour, ts) + interval 1 hour <= (select max(ts) from events) - interval 10 minutes group by all",
}
QUERIES = {n: globals()[n] for n in [*ORACLE_SQL, "power_fit"]}
