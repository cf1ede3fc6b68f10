"""Runs, their checks and their files as tables: digests, tamper checks, orphans, names that stay unique, and roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.running import rank_within, running_sum

#: What the name of a run says about where it comes from, first match first.
SOURCES = (("agent", r"^agent-"), ("cli", r"^cli-"), ("fixture", r"^(refcheck-|variant-)"), ("reference", r"^reference-"), ("candidate", r"-cand\d+$"))


def classify(name: Column, rules: Sequence[tuple[str, str]] = SOURCES, otherwise: str = "unclassified") -> Column:
    """The kind of a name: that of the first pattern that fits."""
    out = F.lit(otherwise)
    for kind, pattern in reversed(rules):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    return F.when(name.isNull(), otherwise).otherwise(out)


def owned(name: Column) -> Column:
    """Whether a run belongs to the tool itself and may be written again."""
    return F.coalesce(name.rlike(r"^(refcheck-|variant-)") | name.rlike(r"-cand\d+$"), F.lit(False))


def manifest_status(manifest: DataFrame, files: DataFrame, keys: Sequence[str], digest: str = "sha256") -> DataFrame:
    """Rows (keys..., status): equal, mismatched, missing (in the manifest only) or untracked (a file only). Digests that occur twice for a key are compared each."""
    a, b = manifest.select(*keys, F.col(digest).alias("__was"), F.lit(True).alias("__m")), files.select(*keys, F.col(digest).alias("__is"), F.lit(True).alias("__f"))
    status = F.when(F.col("__f").isNull(), "missing").when(F.col("__m").isNull(), "untracked").when(F.col("__was").eqNullSafe(F.col("__is")), "equal").otherwise("mismatched")
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def run_digests(files: DataFrame, run: str = "run_id", path: str = "rel_path", digest: str = "sha256") -> DataFrame:
    """Rows (run, n_files, digest) from the files of each run in the order of their paths; a run without any digest is told by its paths alone."""
    lines = F.sort_array(F.collect_list(F.concat_ws(" ", path, digest)))  # a run has a few dozen files
    return files.groupBy(run).agg(F.count(F.lit(1)).alias("n_files"), F.sha2(F.concat_ws("\n", lines), 256).alias("digest"))


def orphans(runs: DataFrame, index: DataFrame, evidence: DataFrame, id_col: str) -> DataFrame:
    """Rows (id_col, kind) of ids that are not in all three, in all four directions, from one grouped union."""
    sides = {"run": runs, "index": index, "evidence": evidence}
    ids = None
    for name, df in sides.items():
        part = df.select(id_col, F.lit(name).alias("side"))
        ids = part if ids is None else ids.union(part)
    has = ids.groupBy(id_col).agg(*(F.bool_or(F.col("side") == n).alias(n) for n in sides))
    kinds = {"run_not_indexed": F.col("run") & ~F.col("index"), "indexed_without_run": F.col("index") & ~F.col("run"), "indexed_without_evidence": F.col("index") & ~F.col("evidence"), "evidence_not_indexed": F.col("evidence") & ~F.col("index")}
    found = F.filter(F.array(*(F.when(hit, F.lit(k)) for k, hit in kinds.items())), lambda x: x.isNotNull())
    return has.select(id_col, F.explode(found).alias("kind"))


def contained(path: Column, root: str) -> Column:
    """Whether a path lies below root and does not climb out of it."""
    return path.startswith(root.rstrip("/") + "/") & ~F.exists(F.split(path, "/"), lambda p: p == "..") & (path != root)


def prunable(evidence: DataFrame, index: DataFrame, id_col: str, path_col: str, root: str) -> DataFrame:
    """Rows (id_col, path_col, removable) of evidence that no index names; a path outside root is never removable."""
    return evidence.join(index.select(id_col).distinct(), id_col, "left_anti").select(id_col, path_col, F.coalesce(contained(F.col(path_col), root), F.lit(False)).alias("removable"))


def allocate(new: DataFrame, used: DataFrame, prefix: str, order: Sequence[str], number: str = "number") -> DataFrame:
    """new with a column number: the smallest free numbers of its prefix, in order; numbers in used (prefix, number) are skipped.

    The k-th new row gets k plus the used numbers u that lie before it: those with u minus its own
    rank under k. Ranks and counts are running sums, so that a prefix with very many rows is spread over tasks.
    """
    taken = rank_within(used.select(prefix, number).distinct(), [prefix], [number], "__rank")
    # a used number with u - rank = k - 1 comes before the k-th new row
    taken = taken.select(prefix, (F.col(number) - F.col("__rank") + 1).alias("__at"), F.lit(0).alias("__new"), F.lit(None).cast("long").alias("__k"))
    rows = rank_within(new, [prefix], list(order), "__k")
    both = taken.union(rows.select(prefix, F.col("__k").alias("__at"), F.lit(1).alias("__new"), "__k"))
    counted = running_sum(both, [prefix], ["__at", "__new"], 1 - F.col("__new"), "__before").filter("__new = 1")
    numbered = counted.select(prefix, "__k", (F.col("__k") + F.col("__before")).alias(number))
    return rows.join(numbered, [prefix, "__k"]).drop("__k")


def duplicate_checks(checks: DataFrame, run: str = "run_id", name: str = "name") -> DataFrame:
    """Rows (run, name, n) of check names that a report has more than once."""
    return checks.groupBy(run, name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def overwritten(old: DataFrame, new: DataFrame, id_col: str, digest: str = "digest") -> DataFrame:
    """Rows (id_col, was, is) of runs that a second writing replaced by something else."""
    j = old.select(id_col, F.col(digest).alias("was")).join(new.select(id_col, F.col(digest).alias("is")), id_col)
    return j.filter(~F.col("was").eqNullSafe(F.col("is")))


def failed_catalogue(checks: DataFrame, run: str = "run_id", most: int = 120) -> DataFrame:
    """Rows (run, failed): runs with a failed check and their failed checks in order, the first runs by name."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("name"))))  # distinct names of checks, a few
    return checks.groupBy(run).agg(F.array_join(failed, ",").alias("failed")).filter("failed <> ''").orderBy(run).limit(most)


def discrimination(checks: DataFrame, role: str = "role", case: str = "candidate") -> DataFrame:
    """Rows (judge, n_reference, passed_reference, n_wrong, failed_wrong) of each kind of check, of all together, of the numeric ones, and of wrong cases that scale checks alone catch.

    checks: (case, role reference or wrong, name, passed). A judge made of several passes a case if all its checks do.
    """
    kind = F.when(F.col("name").startswith("scale-"), F.regexp_replace(F.regexp_replace("name", r"^scale-", ""), r"-\d+$", "")).otherwise(F.col("name"))
    scale = F.col("name").startswith("scale-")
    single = checks.groupBy(kind.alias("judge"), role, case).agg(F.bool_and("passed").alias("ok"))
    each = checks.groupBy(role, case).agg(F.bool_and("passed").alias("all"), F.coalesce(F.bool_and(F.when(~scale, F.col("passed"))), F.lit(True)).alias("numeric"))
    whole = each.select(role, case, F.inline(F.array(F.struct(F.lit("(all gates)").alias("judge"), F.col("all").alias("ok")), F.struct(F.lit("(numeric gates)").alias("judge"), F.col("numeric").alias("ok")), F.struct(F.lit("(scale gates alone)").alias("judge"), (~(F.col("numeric") & ~F.col("all"))).alias("ok")))))
    rows = single.select("judge", role, "ok").union(whole.select("judge", role, "ok"))
    ref, wrong = F.col(role) == "reference", F.col(role) == "wrong"
    return rows.groupBy("judge").agg(F.count_if(ref).alias("n_reference"), F.count_if(ref & F.col("ok")).alias("passed_reference"), F.count_if(wrong).alias("n_wrong"), F.count_if(wrong & ~F.col("ok")).alias("failed_wrong"))


def latest(rows: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """Rows (key, value): of each key the value that comes last in order. Combined before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def resolve(rows: DataFrame, lookups: Sequence[tuple[DataFrame, str, str]], result: str, otherwise: Column) -> DataFrame:
    """rows with result: from the first lookup (table of key and value, row's key column, value column) that has it, else otherwise; of values of one key the least."""
    out, found = rows, []
    for i, (table, key, value) in enumerate(lookups):
        names = table.columns
        side = table.groupBy(F.col(next(c for c in names if c != value)).alias(f"__k{i}")).agg(F.min(value).alias(f"__v{i}"))
        out = out.join(side, F.col(key) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        found.append(F.col(f"__v{i}"))
    return out.withColumn(result, F.coalesce(*found, otherwise)).drop(*(f"__v{i}" for i in range(len(lookups))))


def best_session(export: DataFrame, ledger: DataFrame, on: Sequence[str], session: str) -> DataFrame:
    """Rows (session, matched, of): the session of the ledger that shares most events with the export, the first by name of equals."""
    n = ledger.groupBy(session).agg(F.count(F.lit(1)).alias("of"))
    hits = ledger.join(export.select(*on).distinct(), list(on), "left_semi").groupBy(session).agg(F.count(F.lit(1)).alias("matched"))
    return n.join(hits, session).orderBy(F.desc("matched"), session).limit(1).select(session, "matched", "of")


def rates(rows: DataFrame, by: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """Rows (by..., n, <flag>, <flag>_rate): how many rows of a group have each flag, and their share."""
    a = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    return a.select(*by, "n", *(x for k in flags for x in (F.col(k), F.round(F.col(k) / F.col("n"), 6).alias(f"{k}_rate"))))
