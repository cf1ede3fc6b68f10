"""Registered queries of the contract audit: parts stand for tasks, lines for cells, orders and their keys for the parts of a set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import contract

_id = "concat('T', p_partkey)"
# The derived tables are SQL text for both engines; only arrays and maps are spelled differently.
_META = f"""select {_id} as task_id, case when p_size = 1 then 'other' else {_id} end as folder,
  case p_size when 2 then EMPTY when 3 then array('x', 'x') when 4 then array('y', 'x') when 5 then array('x') when 6 then null when 7 then array('1x', 'z') else array('x', 'z') end as var_names,
  case when p_size = 8 then 'odd' when p_brand < 'Brand#30' then 'base' else 'challenge' end as layer,
  case p_size when 9 then EMPTY when 10 then array('a book') else array(concat('https://', p_brand)) end as source,
  case p_size when 11 then null when 12 then MAP(array('x', 'w', 'z', 'y'), array('m', 'm', 's', 'm')) when 13 then MAP(array('x', 'z', 'y'), array('parsec', 's', 'm')) when 14 then MAP(array('x', 'z'), array('m', 's'))
    when 24 then MAP(array('x', 'z', 'y'), array('J/(kg*K)', 'm2', 'ohm')) else MAP(array('x', 'z', 'y'), array('m', 's^-2', 'm/s')) end as units,
  case p_size when 15 then array('x') when 16 then array('k', 'k') when 17 then array('2k') else array('k') end as free_parameters,
  case p_size when 18 then MAP(array('x'), array(array(1e0))) when 19 then MAP(array('w'), array(array(0e0, 1e0))) when 20 then MAP(array('x'), array(array(2e0, 1e0))) else MAP(array('x'), array(array(0e0, 1e0))) end as sampling,
  case when p_size = 21 then -1 else p_size * 10 end as sample_count from part"""


def _spark_text(text: str) -> str:
    return text.replace("EMPTY", "cast(array() as array<string>)").replace("MAP(", "map_from_arrays(")


def _duck_text(text: str) -> str:
    return text.replace("EMPTY", "[]::varchar[]").replace("array(", "list_value(").replace("MAP(", "map(")


def contract_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the metadata audit by code: twenty conditions in one scan."""
    metas = spark.sql(_spark_text(_META).replace("from part", "from {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return contract.meta_findings(metas).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"), F.min("task_id").alias("first_task"))


_NAMES = "'^[A-Za-z_][A-Za-z0-9_]*$'"
_UNIT = r"'^\(*(?:kg|m|s|A|K|mol|cd|g|N|J|W|Pa|Hz|rad|C|V|T|Wb|F|H|ohm|S|-|\d+)\)*(?:\^\(?-?\d+\)?|\d+)?\)*(?:[*/]\(*(?:kg|m|s|A|K|mol|cd|g|N|J|W|Pa|Hz|rad|C|V|T|Wb|F|H|ohm|S|-|\d+)\)*(?:\^\(?-?\d+\)?|\d+)?\)*)*$'"
_any = lambda column, test: f"coalesce(len(list_filter({column}, lambda e: {test})) > 0, false)"
_CONDITIONS = [
    ("error", "MISSING_FIELD", "var_names is null or source is null"), ("error", "BAD_TYPE", "sample_count is null or sample_count < 0"), ("error", "TASK_ID_MISMATCH", "task_id <> folder"),
    ("error", "BAD_VAR_NAMES", f"len(var_names) = 0 or {_any('var_names', f'not regexp_matches(e, {_NAMES})')}"), ("error", "DUP_VAR", "len(list_distinct(var_names)) < len(var_names)"),
    ("error", "RESERVED_NAME", "list_contains(var_names, 'y')"), ("warn", "FEW_VARS", "len(var_names) = 1"), ("error", "BAD_LAYER", "layer not in ('base', 'challenge')"),
    ("error", "EMPTY_SOURCE", "len(source) = 0"), ("warn", "SOURCE_NOT_URL", _any("source", "not regexp_matches(e, '^https?://')")), ("error", "BAD_UNITS", "units is null"),
    ("warn", "UNKNOWN_UNIT_KEY", _any("map_keys(units)", "not list_contains(list_concat(coalesce(var_names, []), coalesce(free_parameters, []), ['y']), e)")),
    ("warn", "UNKNOWN_UNIT", _any("map_values(units)", f"not regexp_matches(trim(e), {_UNIT})")), ("warn", "MISSING_Y_UNIT", "not list_contains(map_keys(units), 'y')"),
    ("error", "BAD_PARAMS", _any("free_parameters", f"not regexp_matches(e, {_NAMES})")), ("error", "PARAM_COLLISION", "list_has_any(free_parameters, list_concat(var_names, ['y']))"), ("error", "DUP_PARAM", "len(list_distinct(free_parameters)) < len(free_parameters)"),
    ("error", "BAD_SAMPLING", _any("map_values(sampling)", "len(e) <> 2")), ("error", "SAMPLING_UNKNOWN_VAR", _any("map_keys(sampling)", "not list_contains(var_names, e)")), ("error", "SAMPLING_RANGE", _any("map_values(sampling)", "len(e) = 2 and e[1] >= e[2]")),
]

# A task for each supplier: its lines' cells as text, of which some are bad.
_TASKS = """select concat('S', s_suppkey) as task_id, array('x', 'z') as var_names, case s_nationkey when 0 then array('y', 'x', 'x') when 1 then array('x', 'z', 'w') when 2 then array('y', 'x', 'w') else array('y', 'x', 'z') end as header,
  case when s_nationkey < 12 then 600 else 20 + s_nationkey end as sample_count, case when s_nationkey % 2 = 0 then MAP(array('x'), array(array(0e0, 50e0))) else MAP(array('x'), array(array(0e0, 20e0))) end as sampling, s_nationkey as nation from supplier"""
_LINES = """select concat('S', l_suppkey) as task_id, l_orderkey * 10 + l_linenumber as line_no, case when nation = 5 and l_linenumber = 1 then array(' 1 ', '2') when nation = 6 and l_linenumber = 2 then array('  ', '', ' ')
  else array(case when nation = 7 and l_linenumber = 3 then 'n/a' when nation = 8 and l_linenumber = 1 then 'NaN' when nation = 9 and l_linenumber = 4 then '-Infinity' else cast(cast(l_extendedprice as bigint) as varchar(20)) end,
    cast(cast(l_quantity as bigint) as varchar(20)), case when nation = 10 then '3' else cast(l_linenumber as varchar(20)) end) end as cells from lineitem join (select s_suppkey as key, s_nationkey as nation from supplier) n on l_suppkey = key where nation <> 11"""


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    supplier, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "lineitem"))
    lines = _spark_text(_LINES).replace("from supplier", "from {supplier}").replace("from lineitem", "from {lineitem}")
    return spark.sql(_spark_text(_TASKS).replace("from supplier", "from {supplier}"), supplier=supplier), spark.sql(lines, supplier=supplier, lineitem=lineitem)


def contract_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the data audit: twelve conditions from one grouped aggregate over all cells."""
    return contract.cell_findings(*_cells(spark, sf_dir), least=550, enough=600)


def first_bad_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five bad cells of each task."""
    return contract.first_bad_cells(*_cells(spark, sf_dir))


def contract_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a set of tasks by code: missing and orphaned answers, splits and sealed parts, doubled ids, files that leak or are missing."""
    o, c, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "lineitem"))
    ids = lambda df, x: df.select(F.expr(x).alias("task_id")).distinct()
    tasks = c.select(F.expr("case when c_nationkey = 3 then concat('t', c_custkey div 2) else concat('T', c_custkey) end").alias("task_id"))
    references = ids(o.filter("o_orderpriority = '1-URGENT'"), "concat('T', o_custkey + 5)")
    splits, sealed = ids(o.filter("o_orderstatus = 'F'"), "concat('T', o_custkey)"), ids(o.filter("o_orderstatus = 'P'"), "concat('T', o_custkey)")
    names = F.expr("case o_orderpriority when '1-URGENT' then 'meta.json' when '2-HIGH' then 'data.csv' when '3-MEDIUM' then 'my_answer.txt' when '4-NOT SPECIFIED' then 'notes.txt' when '5-LOW' then element_at(array('split.json', 'ground.csv', 'Labels.csv', 'golden.json', 'expected_formula.txt', 'answers.md'), cast(o_custkey % 6 as int) + 1) end")
    files = o.select(F.expr("concat('T', o_custkey)").alias("task_id"), names.alias("name"), (F.col("o_orderstatus") != "P").alias("readable"))
    return contract.set_findings(tasks, references, files, splits, sealed).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"), F.min("task_id").alias("first_task"))


_list = lambda c: "[" + ", ".join(f"{{'severity': '{s}', 'code': '{k}', 'hit': coalesce({x}, false)}}" for s, k, x in c) + "]"
_CELL_CONDITIONS = [
    ("error", "EMPTY_CSV", "n = 0"), ("error", "CSV_DUP_COL", "len(list_distinct(header)) < len(header)"), ("error", "CSV_MISSING_Y", "not list_contains(header, 'y')"), ("error", "CSV_MISSING_COL", _any("var_names", "not list_contains(header, e)")),
    ("error", "CSV_RAGGED", "ragged > 0"), ("error", "CSV_NON_NUMERIC", "txt > 0"), ("error", "CSV_NONFINITE", "endless > 0"), ("error", "CSV_TOO_FEW", "n > 0 and n < 550"), ("warn", "CSV_BELOW_MIN", "n >= 550 and n < 600"),
    ("error", "SAMPLE_COUNT_MISMATCH", "sample_count <> n"), ("error", "CONSTANT_COL", "constant"), ("warn", "SAMPLING_MISMATCH", "outside > 0"),
]
_CELL_SQL = f"""with tasks as ({_duck_text(_TASKS)}), raw as ({_duck_text(_LINES)}),
lines as (select task_id, line_no, list_transform(cells, lambda c: trim(c)) as cells from raw),
j as (select l.*, header, sampling, len(cells) = len(header) as whole, case when len(cells) = len(header) then list_transform(cells, lambda c: try_cast(c as double)) end as vals from lines l join tasks using (task_id) where len(list_filter(cells, lambda c: c <> '')) > 0),
h as (select task_id, count(*) as n, count(*) filter (not whole) as ragged, count(*) filter (len(list_filter(vals, lambda x: x is null)) > 0) as txt, count(*) filter (len(list_filter(vals, lambda x: x is not null and not isfinite(x))) > 0) as endless,
  count(*) filter (vals[list_position(header, 'x')] < sampling['x'][1] or vals[list_position(header, 'x')] > sampling['x'][2]) as outside from j group by task_id),
k as (select task_id, bool_or(constant) as constant from (select task_id, place, min(v) = max(v) as constant from (select task_id, unnest(range(len(vals))) as place, unnest(vals) as v from j) group by task_id, place) group by task_id),
a as (select t.*, coalesce(h.n, 0) as n, ragged, txt, endless, outside, constant from tasks t left join h using (task_id) left join k using (task_id))"""

ORACLE_SQL = {
    "contract_meta": f"with metas as ({_duck_text(_META)}), f as (select task_id, unnest(list_filter({_list(_CONDITIONS)}, lambda x: x.hit)) as f from metas) select f.severity as severity, f.code as code, cast(count(*) as bigint) as n, min(task_id) as first_task from f group by all",
    "contract_cells": f"{_CELL_SQL}, f as (select task_id, unnest(list_filter({_list(_CELL_CONDITIONS)}, lambda x: x.hit)) as f from a) select task_id, f.severity as severity, f.code as code from f",
    "first_bad_cells": f"""{_CELL_SQL}, e as (select task_id, line_no, unnest(range(len(cells))) as place, unnest(cells) as cell, header from lines join tasks using (task_id) where len(cells) = len(header)),
      b as (select *, row_number() over (partition by task_id order by line_no, place) as k from e where try_cast(cell as double) is null or not isfinite(try_cast(cell as double))) select task_id, line_no, header[place + 1] as name, cell from b where k <= 5""",
    "contract_set": """with tasks as (select case when c_nationkey = 3 then concat('t', c_custkey // 2) else concat('T', c_custkey) end as task_id from customer),
      r as (select distinct concat('T', o_custkey + 5) as task_id from orders where o_orderpriority = '1-URGENT'), s as (select distinct concat('T', o_custkey) as task_id from orders where o_orderstatus = 'F'), e as (select distinct concat('T', o_custkey) as task_id from orders where o_orderstatus = 'P'),
      f as (select concat('T', o_custkey) as task_id, case o_orderpriority when '1-URGENT' then 'meta.json' when '2-HIGH' then 'data.csv' when '3-MEDIUM' then 'my_answer.txt' when '4-NOT SPECIFIED' then 'notes.txt' else ['split.json', 'ground.csv', 'Labels.csv', 'golden.json', 'expected_formula.txt', 'answers.md'][o_custkey % 6 + 1] end as name, o_orderstatus <> 'P' as readable from orders),
      d as (select distinct task_id from tasks),
      x as (select 'error' as severity, 'MISSING_REFERENCE' as code, task_id from d where task_id not in (select task_id from r)
        union all select 'error', 'ORPHAN_REFERENCE', task_id from r where task_id not in (select task_id from d)
        union all select 'error', 'SPLIT_MISSING', task_id from d where task_id not in (select task_id from s)
        union all select 'warn', 'SEALED_MISSING', task_id from d where task_id in (select task_id from s) and task_id not in (select task_id from e)
        union all select 'error', 'DUP_TASK_ID', lower(task_id) from tasks group by lower(task_id) having count(*) > 1
        union all select 'error', 'LEAK_FILE', task_id from d where task_id in (select task_id from f where name not in ('meta.json', 'data.csv', 'notes.txt', 'split.json'))
        union all select 'error', 'MISSING_META', task_id from d where task_id not in (select task_id from f where name = 'meta.json')
        union all select 'error', 'MISSING_CSV', task_id from d where task_id not in (select task_id from f where name = 'data.csv')
        union all select 'error', 'BAD_JSON', task_id from d where task_id in (select task_id from f where name = 'meta.json' and not readable)
        union all select 'error', 'NO_TASKS', '*' where not exists (select 1 from tasks) union all select 'error', 'MISSING_REFERENCE_ROOT', '*' where not exists (select 1 from r))
      select severity, code, cast(count(*) as bigint) as n, min(task_id) as first_task from x group by all""",
}
QUERIES = {n: globals()[n] for n in ORACLE_SQL}
