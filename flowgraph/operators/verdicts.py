"""Verdicts on flows: roll-ups, constraint outcomes, pruning and vulnerability lists.

verdicts: group_id, success, flow_id, ord, source_location, sink_location, assessment, satisfiable, valid_syntax,
iterations, requested (array of ids). A group that failed has success false and counts only as a group and an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgraph.functions import fixed
from flowgraph.operators.rows import numbered

TRUE_POSITIVE, FALSE_POSITIVE, UNKNOWN, NEEDS_CONTEXT = fixed.ASSESSMENTS


def outcome(satisfiable: Column, valid: Column) -> Column:
    """sat, unsat or unknown for constraints that parse, error for all else."""
    return F.when(F.coalesce(valid, F.lit(False)) & satisfiable.isin("sat", "unsat", "unknown"), satisfiable).otherwise(F.lit("error"))


def pruned(assessment: Column, satisfiable: Column, valid: Column, on: bool = True) -> Column:
    """Whether a true positive falls because its path constraints are proven unsatisfiable."""
    return F.lit(on) & (assessment == TRUE_POSITIVE) & (outcome(satisfiable, valid) == "unsat")


def empty_constraints(text: Column) -> Column:
    """Whether there is nothing to solve: no line but comments, or none that asserts; the template's own texts have none."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~F.startswith(s, F.lit(";")))
    return ~F.exists(lines, lambda s: F.contains(s, F.lit("(assert")))


def group_rollup(verdicts: DataFrame) -> DataFrame:
    """For each group: flows, counts by assessment and the flows' ids, in their order, for each."""
    is_ = lambda a: F.col("assessment") == a
    ids = lambda a: F.transform(F.array_sort(F.collect_list(F.when(is_(a), F.struct("ord", "flow_id")))), lambda x: x["flow_id"])
    names = {"true_positives": TRUE_POSITIVE, "false_positives": FALSE_POSITIVE, "unknowns": UNKNOWN, "needs_more_context": NEEDS_CONTEXT}
    return verdicts.groupBy("group_id").agg(
        F.count("*").alias("total_flows"), *[F.count_if(is_(a)).alias(n) for n, a in names.items()], *[ids(a).alias(f"{n}_ids") for n, a in names.items()],
    )


def report(verdicts: DataFrame, prune: bool = True) -> DataFrame:
    """One row over all groups: counts, constraint outcomes of true positives, counts after pruning, and rates."""
    good = F.col("success")
    is_ = lambda a: good & (F.col("assessment") == a)
    z = outcome(F.col("satisfiable"), F.col("valid_syntax"))
    flows, tp, fp = F.count_if(good), F.count_if(is_(TRUE_POSITIVE)), F.count_if(is_(FALSE_POSITIVE))
    cut = F.count_if(good & pruned(F.col("assessment"), F.col("satisfiable"), F.col("valid_syntax"), prune))
    rate = lambda part: F.bround(100 * part / F.greatest(flows, F.lit(1)), 1)
    return verdicts.agg(
        F.count_distinct("group_id").alias("total_groups"), flows.alias("total_flows"), tp.alias("true_positives"), (tp - cut).alias("true_positives_kept"), cut.alias("true_positives_pruned"),
        fp.alias("false_positives"), F.count_if(is_(NEEDS_CONTEXT)).alias("needs_more_context"), F.count_if(is_(UNKNOWN)).alias("unknowns"),
        F.count_distinct(F.when(~good, F.col("group_id"))).alias("errors"),
        *[F.count_if(is_(TRUE_POSITIVE) & (z == k)).alias(f"tp_{k}") for k in ("sat", "unsat", "unknown", "error")],
        rate(tp).alias("vulnerability_rate"), rate(fp).alias("false_positive_rate"),
        F.bround(F.coalesce(F.sum(F.when(good, F.col("iterations"))), F.lit(0)) / F.greatest(flows, F.lit(1)), 1).alias("average_iterations"),
    )


def requested_ids(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("success").select(F.explode("requested").alias("function_id")).distinct()


def _positives(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("success") & (F.col("assessment") == TRUE_POSITIVE))


def vulnerabilities(verdicts: DataFrame, prune: bool = True) -> DataFrame:
    """True positives that stay, by sink: id V001..., sink, sorted sources, flows in their order; ids by first flow."""
    kept = _positives(verdicts).where(~pruned(F.col("assessment"), F.col("satisfiable"), F.col("valid_syntax"), prune))
    grouped = kept.groupBy(F.col("sink_location").alias("sink")).agg(
        F.min("ord").alias("_first"), F.sort_array(F.collect_set("source_location")).alias("sources"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "flow_id"))), lambda x: x["flow_id"]).alias("flows"),
    )
    return numbered(grouped, "id", "_first", "sink", start=1, pattern="V%03d").select("id", "sink", "sources", "flows")


def vulnerable_pairs(verdicts: DataFrame) -> DataFrame:
    """True positives by source and sink, none pruned, with their flows in order."""
    flows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "flow_id"))), lambda x: x["flow_id"])
    return _positives(verdicts).groupBy("source_location", "sink_location").agg(F.count("*").alias("flow_count"), flows.alias("flows"))


def flow_text(steps: Column) -> Column:
    """A flow's steps as lines: role, place and statement."""
    return F.array_join(F.transform(steps, lambda s: F.concat_ws(" | ", s["step_role"], s["location"], s["statement"])), "\n")


def name_patterns(operations: DataFrame) -> list[str]:
    """Exact-name patterns of the distinct names of operations, sorted; a pattern table is as small as its manifest."""
    return [f"^{re.escape(r.name)}$" for r in operations.select("name").where("name is not null").distinct().orderBy("name").collect()]
