"""Knapsack instances: construction, features, identity, text, solving and generation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.functions.arrays import sig7
from satchel.operators import augment, features, hashing, solve, text
from satchel.queries.common import INSTANCES, instances, rounded, seven_sql, sig, stats_sql
from satchel.sources import tables


def kp_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return instances(spark, sf_dir).select("instance_id", "ord", as_text("weights"), as_text("profit"), "capacity")


def kp_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.items(instances(spark, sf_dir)).withColumn("i", F.col("i").cast("long"))


def kp_trivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances into which everything fits: the optimum is the sum of the profits."""
    rows = tables.kp_instances(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), binding=False)
    return solve.solutions(rows).select("instance_id", "objective", "selected_weight")


def kp_domain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.domain_features(instances(spark, sf_dir)))


def kp_relation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.relation_features(instances(spark, sf_dir)))


def kp_feature_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form, aggregated: rows, mean, and how many values are not finite, for each of the 100 features."""
    means = features.feature_means(rounded(features.all_features(instances(spark, sf_dir))))
    return means.select("feature", "rows", sig7(F.col("mean")).alias("mean"), "not_finite")


def kp_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hashing.with_proportional_hash(hashing.with_hashes(instances(spark, sf_dir)))
    return rows.select("instance_id", "canonical_hash", "proportional_hash", hashing.canonical_hash(generated=True).alias("generated_hash"), hashing.split_group(F.col("canonical_hash")).alias("split_group"))


def kp_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.numbered(hashing.dedupe(instances(spark, sf_dir))).select("ord", F.col("sequence").cast("long").alias("sequence"), "numbered_id")


def kp_scaled_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each instance with its triple: the classes of proportional instances, and the first of each that stays."""
    rows = instances(spark, sf_dir)
    times = lambda c: F.transform(c, lambda v: 3 * v).alias(c)
    copies = rows.select(F.concat("instance_id", F.lit("_3")).alias("instance_id"), (F.col("ord") + 1_000_000_000).alias("ord"), times("weights"), times("profit"), (3 * F.col("capacity")).alias("capacity"))
    return hashing.dedupe(rows.unionByName(copies)).select("instance_id", "ord")


def kp_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with instances in which single values were spoilt by a rule on the order number."""
    rows = instances(spark, sf_dir).withColumn("k", F.col("ord") % 7)
    first = lambda c, bad: F.transform(c, lambda v, i: F.when((i == 0) & bad, -v).otherwise(v)).alias(c)
    rows = rows.select("instance_id", first("weights", F.col("k") == 1), first("profit", F.col("k") == 2), F.when(F.col("k") == 3, 0).otherwise(F.col("capacity")).alias("capacity"))
    checked = hashing.validated(rows)
    return checked.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("rows"))


def kp_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.element_at(F.array(F.lit("sage"), F.lit("sage_original"), F.lit("synthetic"), F.lit("other")), (F.col("ord") % 4 + 1).cast("int"))
    rows = hashing.normalized(instances(spark, sf_dir).withColumn("origin", origin))
    return rows.groupBy("source_kind", "generation_depth").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("split_group").alias("groups"), F.sum("n_items").alias("items"))


def kp_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.render(instances(spark, sf_dir))
    return rows.select("instance_id", F.sha2("question", 256).alias("question_sha256"), F.length("question").cast("long").alias("chars"))


def kp_parse_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the JVM parser reads back from the rendered questions."""
    rows = text.parse_rendered(text.render(instances(spark, sf_dir)))
    as_text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return rows.select("instance_id", as_text("weights"), as_text("profit"), "capacity")


def kp_parse_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parser of all written forms reads back."""
    rows = text.parse_questions(text.render(instances(spark, sf_dir)))
    as_text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return rows.select("instance_id", as_text("weights"), as_text("profit"), "capacity", "parsed")


#: How an item may be written; {i}, {p} and {w} are its number, profit and weight.
ITEM_LINES = (
    "Item {i}: Value = {p}, Weight = {w} kg", "2. Package {i}: Weight = {w}, Value = {p}", "Resource {i} has an educational value of {p} units and costs {w} units.",
    "item_{i} (value = {p}, weight: {w})", "`item_{i}`: Value = {p}, Weight = {w}", "The next one, item_{i}, has a value of {p} units and weighs {w} units.",
    "item_{i} is valued at {p} units and weighs {w} units", "Item_{i}: Valued at {p} units, weighing {w} units.", "Item {i}: Valued at {p} units, with a cost of {w} units.",
    "Candidate {i}: Utility of {p}, weight of {w}", "Item {i} has a value of {p} and a cost of {w}", "Cargo {i} has a value of {p} and a weight of {w}",
    "Item {i} with a value of {p} and weight of {w}", "Project {i}: This project contributes an educational value of {p} units and adds a workload of {w} units.",
    "Item {i}: Valued at {p} units with a weight of {w} units.", "Shipment {i}:\n  - Value: ${p}\n  - Weight: {w} kg",
)
#: Lists of both: the line before, and each item's line, of profits and of weights; and tables: header and row.
ITEM_LISTS = ((("Revenue of each:", "- Item {i}: ${p}"), ("Weight of each:", "- Item {i}: {w} kg")), (("", "Crop {i}: {p} units of value"), ("", "Crop {i}: {w} units of weight")))
ITEM_TABLES = (("| Item | Size | Weight | Revenue |\n|---|:---:|---|---|", "| {i} | 7 | {w} | {p} |"), ("| Project | Expense | Expected return |\n| --- | --- | --- |", "| P{i} | {w} million | {p} |"))
#: How the capacity may be written.
CAPACITIES = (
    "It has a maximum weight capacity of {c} units.", "It has a capacity of {c} units.", "A weight capacity of {c} kg is given.", "There is a capacity limit of {c} units.", "There is a maximum capacity of {c}.",
    "The load must not exceed {c} kilograms.", "See that the load does not exceed {c} units.", "The budget for all of it is {c} units.", "Take no more than {c} units.",
    "The total weight capacity here is {c} units.", "The total workload capacity is limited to {c} units.", "The weight limit for all is {c}.", "There is a budget of {c} million yuan.",
)


def written(rows: DataFrame) -> DataFrame:
    """(instance_id, question): instance ``ord`` in written form ord mod 20 with capacity phrase ord mod 13; every second one with thousands separators."""
    shown = lambda v: F.when(F.col("ord") % 2 == 0, v.cast("string")).otherwise(F.format_number(v, 0))

    def filled(template: str, **values) -> Column:
        return F.concat(*(values[x[1]] if len(x) == 3 and x[0] == "{" else F.lit(x) for x in re.split(r"(\{\w\})", template) if x))

    def lines(template: str) -> Column:
        items = F.arrays_zip("profit", "weights")
        return F.array_join(F.transform(items, lambda x, i: filled(template, i=i.cast("string"), p=shown(x["profit"]), w=shown(x["weights"]))), "\n")

    forms = [lines(t) for t in ITEM_LINES]
    forms += [F.concat_ws("\n", *(x for head, line in sides for x in (F.lit(head), lines(line))), F.lit("Objective: the most in total.")) for sides in ITEM_LISTS]
    forms += [F.concat_ws("\n", F.lit(head), lines(row)) for head, row in ITEM_TABLES]
    chosen = F.coalesce(*(F.when(F.col("ord") % len(forms) == k, f) for k, f in enumerate(forms)))
    capacity = F.coalesce(*(F.when(F.col("ord") % len(CAPACITIES) == k, filled(c, c=shown(F.col("capacity")))) for k, c in enumerate(CAPACITIES)))
    return rows.select("instance_id", F.concat(F.lit("Choose **some** of these.\n"), capacity, F.lit("\n\n"), chosen, F.lit("\n\n# Note: Item 3: Value = 1, Weight = 1")).alias("question"))


def kp_parse_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each instance written in one of all forms, and read back."""
    rows = text.parse_questions(written(instances(spark, sf_dir)))
    as_text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return rows.select("instance_id", as_text("weights"), as_text("profit"), "capacity", "parsed")


def kp_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = instances(spark, sf_dir).withColumn("capacity", F.col("capacity") * F.element_at(F.array(F.lit(1), F.lit(10), F.lit(100)), (F.col("ord") % 3 + 1).cast("int")))
    return solve.gates(rows)


def kp_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact optimum of all instances; the SQL tries all subsets."""
    return kp_optimum_all(spark, sf_dir)


def kp_optimum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact optimum of all instances, without SQL, for orders with more lines than SQL can try subsets of."""
    return solve.solutions(instances(spark, sf_dir)).select("instance_id", "objective")


def kp_formulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the formulations' objectives agree."""
    found = solve.wide(solve.run_formulations(instances(spark, sf_dir)), "objective")
    same = lambda f: F.count_if(F.col(f) == F.col("compact")).alias(f"{f}_agrees")
    return found.agg(F.count(F.lit(1)).alias("instances"), *(F.count(f).alias(f"{f}_solved") for f in solve.FORMULATIONS), *(same(f) for f in solve.FORMULATIONS[1:]))


def kp_solution_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solver output as the formulations would write it, some of it spoilt, and what the checks find."""
    rows = instances(spark, sf_dir)
    found = rows.join(solve.solutions(rows), "instance_id")
    n = F.size("weights")
    index = F.sequence(F.lit(0), n - 1)
    x = F.map_from_entries(F.transform(index, lambda i: F.struct(F.concat(F.lit("x_"), i.cast("string")), F.when(F.array_contains("selected", i) | (F.col("ord") % 5 == 1), 1.0).otherwise(0.0))))
    objective = F.map_from_entries(F.transform(index, lambda i: F.struct(F.concat(F.lit("x_"), i.cast("string")), (F.get("profit", i) + F.when((F.col("ord") % 5 == 2) & (i == 0), 1).otherwise(0)).cast("double"))))
    outputs = found.select("instance_id", "ord", "weights", "profit", "capacity", n.alias("n"), F.when(F.col("ord") % 5 == 3, "kp_qubo_v1").otherwise("kp_compact_v1").alias("formulation_id"), x.alias("variables"), objective.alias("objective_linear"))
    checked = solve.objective_errors(solve.signature_errors(outputs))
    checked = checked.withColumn("selected", solve.selected_items(F.col("variables"))).withColumn("feasibility_errors", solve.feasibility_errors(F.col("weights"), F.col("capacity"), F.col("selected")))
    kinds = [F.array_join(c, ",").alias(c) for c in ("signature_errors", "objective_errors", "feasibility_errors")]
    return checked.groupBy(F.col("ord") % 5, *kinds).agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("(ord % 5)", "kind")


def kp_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solve.registry(spark).select("formulation_id", "formulation", "family", F.array_join("required_symbols", ",").alias("required"), "minimum_items", "maximum_items", "maximum_capacity")


def kp_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by size and whether an item does not fit."""
    rows = instances(spark, sf_dir)
    over = F.exists("weights", lambda w: w > F.col("capacity"))
    return rows.groupBy(F.size("weights").cast("long").alias("n_items"), over.alias("has_oversize")).agg(F.count(F.lit(1)).alias("rows"), F.sum("capacity").alias("capacity"))


def kp_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20,000 generated instances with all orders as parents, none a multiple of any order's instance."""
    rows = instances(spark, sf_dir)
    return augment.generate(spark, rows, 20_000, 20260924, rows).drop("weights", "profit", "operator_parameters")


QUERIES = {
    f.__name__: f
    for f in (
        kp_instances, kp_items, kp_trivial, kp_domain_features, kp_relation_features, kp_feature_means, kp_hashes, kp_dedupe, kp_scaled_copies, kp_validation, kp_normalized,
        kp_questions, kp_parse_rendered, kp_parse_questions, kp_parse_forms, kp_gates, kp_optimum, kp_optimum_all, kp_formulations, kp_solution_checks, kp_registry, kp_audit, kp_generate,
    )
}

_ALL = "list_transform(list_concat(list_concat(weights, profit), [capacity]), lambda v: CAST(v AS VARCHAR))"
_TEXTS = f"'[\"' || array_to_string({_ALL}, '\",\"') || '\"]'"
_EXACT = f"""sha256('{{"n_items":' || len(weights) || ',"problem":"KP","proportional":false,"weights_profits_capacity":' || {_TEXTS} || '}}')"""
_GENERATED = f"""sha256('{{"problem":"KP","proportional":false,"values":' || {_TEXTS} || '}}')"""
_VALUES = "list_concat(list_concat(weights, profit), [capacity])"
_UNIT = f"list_min(list_filter({_VALUES}, lambda v: v <> 0))"
_RATIOS = f"list_transform({_VALUES}, lambda v: format('{{:.15g}}', v / CAST({_UNIT} AS DOUBLE)))"
_PROPORTIONAL = f"""sha256('{{"n_items":' || len(weights) || ',"problem":"KP","proportional":true,"weights_profits_capacity":["' || array_to_string({_RATIOS}, '","') || '"]}}')"""
_KEY = f"array_to_string(list_transform({_VALUES}, lambda v: CAST(v // g AS VARCHAR)), ',')"
_GCD = f"(SELECT *, list_reduce({_VALUES}, lambda a, b: gcd(a, b)) AS g FROM %s)"
_QUESTION = """concat_ws(chr(10), '# Question', '', 'Consider a selection problem with ' || n || ' items and a capacity of ' || capacity || '.', 'Each item has a value and a weight.',
  'The total weight of selected items must not exceed the capacity.', 'Maximize the total value of selected items.', 'Each item can either be fully selected or not selected at all.', '',
  'Number of items: ' || n, 'Capacity: ' || capacity, 'Item details:',
  (SELECT string_agg('- Item ' || i || ': Value = ' || p || ', Weight = ' || w, chr(10) ORDER BY i) FROM item WHERE item.l_orderkey = kp.ord), '', 'Return a mathematical optimization model and executable Python solver code.')"""
_MOMENTS = """m AS (SELECT instance_id, avg(w) AS weights_m, stddev_pop(w) AS weights_d, avg(p) AS profit_m, stddev_pop(p) AS profit_d,
    avg(CAST(p AS DOUBLE) / w) AS profit_weight_ratio_m, stddev_pop(CAST(p AS DOUBLE) / w) AS profit_weight_ratio_d, any_value(c) * 1.0 AS capacity_m, 0.0 AS capacity_d, sum(w) AS total FROM it GROUP BY instance_id)"""
_CAPACITY = [f"CAST({v} AS DOUBLE) AS capacity_{k}" for k, v in {"count": "1", "mean": "any_value(c)", "var": "0", "std": "0", "min": "any_value(c)", "max": "any_value(c)", "q25": "any_value(c)", "median": "any_value(c)", "q75": "any_value(c)", "zero_ratio": "0", "negative_ratio": "0", "unique_ratio": "1", "cv": "0", "skew": "0", "kurtosis": "0"}.items()]
_CAPACITY = [x if "any_value" not in x else f"{sig(x[5 : x.index(' AS DOUBLE')])} AS {x.split(') AS ')[-1]}" for x in _CAPACITY]

ORACLE = {
    "kp_instances": f"WITH {INSTANCES} SELECT instance_id, ord, array_to_string(weights, ',') AS weights, array_to_string(profit, ',') AS profit, capacity FROM kp",
    "kp_items": f"WITH {INSTANCES} SELECT instance_id, i, w, p FROM it",
    "kp_trivial": f"WITH {INSTANCES} SELECT instance_id, CAST(list_sum(profit) AS BIGINT) AS objective, CAST(list_sum(weights) AS BIGINT) AS selected_weight FROM kp",
    "kp_domain_features": f"WITH {INSTANCES}, {_MOMENTS} SELECT it.instance_id, {', '.join([*stats_sql('weights', 'w'), *stats_sql('profit', 'p'), *_CAPACITY, sig('any_value(c) * 1.0 / any_value(total)') + ' AS capacity_total_weight_ratio', *stats_sql('profit_weight_ratio', '(CAST(p AS DOUBLE) / w)')])} FROM it JOIN m ON it.instance_id = m.instance_id GROUP BY it.instance_id",
    "kp_hashes": f"WITH {INSTANCES} SELECT instance_id, {_EXACT} AS canonical_hash, {_PROPORTIONAL} AS proportional_hash, {_GENERATED} AS generated_hash, 'kp-root:' || left(sha256({_EXACT}), 20) AS split_group FROM kp",
    "kp_dedupe": f"""WITH {INSTANCES}, k AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY ord) AS r FROM {_GCD % 'kp'}), f AS (SELECT *, row_number() OVER (ORDER BY ord) AS sequence FROM k WHERE r = 1)
        SELECT ord, sequence, 'sage_original_KP_' || CASE WHEN sequence < 10000 THEN lpad(CAST(sequence AS VARCHAR), 4, '0') ELSE CAST(sequence AS VARCHAR) END || '_' || left({_EXACT}, 10) AS numbered_id FROM f""",
    "kp_scaled_copies": f"""WITH {INSTANCES}, u AS (SELECT instance_id, ord, weights, profit, capacity FROM kp UNION ALL SELECT instance_id || '_3', ord + 1000000000, list_transform(weights, lambda v: 3 * v), list_transform(profit, lambda v: 3 * v), 3 * capacity FROM kp)
        SELECT instance_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY ord) AS r FROM {_GCD % 'u'}) WHERE r = 1""",
    "kp_validation": f"WITH {INSTANCES} SELECT CASE ord % 7 WHEN 1 THEN 'nonpositive_weight' WHEN 2 THEN 'negative_profit' WHEN 3 THEN 'nonpositive_capacity' ELSE '' END AS reasons, count(*) AS rows FROM kp GROUP BY 1",
    "kp_normalized": f"""WITH {INSTANCES} SELECT CASE ord % 4 WHEN 2 THEN 'sage_derived' WHEN 3 THEN 'other' ELSE 'sage_original' END AS source_kind, CAST(ord % 4 > 1 AS INT) AS generation_depth,
        count(*) AS rows, count(DISTINCT {_EXACT}) AS groups, CAST(sum(n) AS BIGINT) AS items FROM kp GROUP BY 1, 2""",
    "kp_questions": f"WITH {INSTANCES}, q AS (SELECT instance_id, {_QUESTION} AS question FROM kp) SELECT instance_id, sha256(question) AS question_sha256, length(question) AS chars FROM q",
    "kp_parse_rendered": f"WITH {INSTANCES} SELECT instance_id, array_to_string(weights, ',') AS weights, array_to_string(profit, ',') AS profit, capacity FROM kp",
    "kp_parse_questions": f"WITH {INSTANCES} SELECT instance_id, array_to_string(weights, ',') AS weights, array_to_string(profit, ',') AS profit, capacity, list_min(weights) > 0 AND list_min(profit) >= 0 AS parsed FROM kp",
    "kp_parse_forms": f"WITH {INSTANCES} SELECT instance_id, array_to_string(weights, ',') AS weights, array_to_string(profit, ',') AS profit, capacity, list_min(weights) > 0 AND list_min(profit) >= 0 AS parsed FROM kp",
    "kp_gates": f"WITH {INSTANCES}, s AS (SELECT instance_id, n, capacity * CASE ord % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END AS c FROM kp) SELECT instance_id, n >= 2 AS compact, n <= 50 AND c <= 5000 AS arc_flow, n <= 25 AS pattern_selection, n <= 30 AND c <= 1000 AS qubo FROM s",
    "kp_optimum": f"""WITH {INSTANCES}, mask AS (SELECT instance_id, unnest(range(1 << CAST(n AS INT))) AS m FROM kp),
        s AS (SELECT mask.instance_id, m, coalesce(sum(w) FILTER ((m >> i) & 1 = 1), 0) AS w, coalesce(sum(p) FILTER ((m >> i) & 1 = 1), 0) AS p, any_value(c) AS c FROM mask JOIN it USING (instance_id) GROUP BY 1, 2)
        SELECT instance_id, CAST(max(p) AS BIGINT) AS objective FROM s WHERE w <= c GROUP BY instance_id""",
    "kp_audit": f"WITH {INSTANCES} SELECT n AS n_items, list_max(weights) > capacity AS has_oversize, count(*) AS rows, CAST(sum(capacity) AS BIGINT) AS capacity FROM kp GROUP BY 1, 2",
}

_R = "(w * 1.0 / c)"
_RELATION = f"""
  b AS (SELECT it.*, w * 1.0 / c AS r, p * 1.0 / w AS d0 FROM it), dm AS (SELECT instance_id, avg(d0) AS dmean FROM b GROUP BY instance_id),
  e AS (SELECT b.*, CASE WHEN dmean > 0 THEN d0 / dmean ELSE 0 END AS d,
          (count(*) OVER lw + 0.0 + (count(*) OVER (PARTITION BY b.instance_id, w) - 1) / 2.0) AS wr, (count(*) OVER lp + (count(*) OVER (PARTITION BY b.instance_id, p) - 1) / 2.0) AS pr,
          row_number() OVER (PARTITION BY b.instance_id ORDER BY w) AS wk, row_number() OVER (PARTITION BY b.instance_id ORDER BY p) AS pk
        FROM b JOIN dm USING (instance_id) WINDOW lw AS (PARTITION BY b.instance_id ORDER BY w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), lp AS (PARTITION BY b.instance_id ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)),
  pairs AS (SELECT a.instance_id, 1.0 - a.r - z.r AS s, (a.w < z.w AND a.p > z.p) OR (a.w > z.w AND a.p < z.p) AS better, a.w = z.w AND a.p = z.p AS same FROM b a JOIN b z ON a.instance_id = z.instance_id AND a.i < z.i),
  partners AS (SELECT a.instance_id, a.i, sum(CAST(1.0 - a.r - z.r >= -1e-12 AND a.i <> z.i AS INT)) * 1.0 / greatest(any_value(a.n) - 1, 1) AS f FROM b a JOIN b z ON a.instance_id = z.instance_id GROUP BY a.instance_id, a.i),
  x AS (SELECT e.instance_id, {', '.join([*seven_sql('kp_relative_weight', 'r'), *seven_sql('kp_relative_value_density', 'd')])},
          {sig('2.0 * sum(wk * w) / (count(*) * sum(w)) - (count(*) + 1.0) / count(*)')} AS kp_weight_gini, {sig('CASE WHEN sum(p) > 0 THEN 2.0 * sum(pk * p) / (count(*) * sum(p)) - (count(*) + 1.0) / count(*) ELSE 0 END')} AS kp_profit_gini,
          {sig('CASE WHEN min(w) = max(w) OR min(p) = max(p) THEN 0 ELSE covar_pop(w, p) / (stddev_pop(w) * stddev_pop(p)) END')} AS kp_weight_profit_pearson,
          {sig('CASE WHEN min(w) = max(w) OR min(p) = max(p) THEN 0 ELSE covar_pop(wr, pr) / (stddev_pop(wr) * stddev_pop(pr)) END')} AS kp_weight_profit_spearman,
          CAST(min(w) = max(w) OR min(p) = max(p) AS DOUBLE) AS kp_weight_profit_correlation_undefined, {sig('avg(CAST(r > 1 + 1e-12 AS INT))')} AS kp_oversize_item_ratio, {sig('avg(CAST(p = 0 AS INT))')} AS kp_zero_profit_item_ratio FROM e GROUP BY e.instance_id),
  y AS (SELECT instance_id, {', '.join(seven_sql('kp_pair_slack', 's'))}, {sig('avg(CAST(s >= -1e-12 AS INT))')} AS kp_pair_fit_ratio, {sig('avg(CAST(abs(s) <= 1e-12 AS INT))')} AS kp_pair_exact_fit_ratio,
          {sig('avg(CAST(better AS INT))')} AS kp_pair_lower_weight_higher_profit_ratio, {sig('avg(CAST(same AS INT))')} AS kp_identical_item_pair_ratio FROM pairs GROUP BY instance_id),
  f AS (SELECT instance_id, {', '.join(seven_sql('kp_partner_fraction', 'f'))} FROM partners GROUP BY instance_id)"""
ORACLE["kp_relation_features"] = f"WITH {INSTANCES}, {_RELATION} SELECT * FROM x JOIN y USING (instance_id) JOIN f USING (instance_id)"
_LONG = f"(UNPIVOT (SELECT d.* EXCLUDE (instance_id), r.* EXCLUDE (instance_id) FROM ({ORACLE['kp_domain_features']}) d JOIN ({ORACLE['kp_relation_features']}) r USING (instance_id)) ON * INTO NAME feature VALUE value)"
ORACLE["kp_feature_means"] = f"SELECT feature, count(*) AS rows, {sig('avg(value)')} AS mean, count(*) FILTER (isnan(value) OR isinf(value)) AS not_finite FROM {_LONG} GROUP BY feature"
#: Every formulation finds the optimum of the instances that its gate lets in.
_OPEN = {"arc_flow": "n <= 50 AND capacity <= 5000", "pattern_selection": "n <= 25", "qubo": "n <= 30 AND capacity <= 1000"}
ORACLE["kp_formulations"] = f"WITH {INSTANCES} SELECT count(*) AS instances, count(*) AS compact_solved, " + ", ".join(f"count(*) FILTER ({v}) AS {k}_{what}" for k, v in _OPEN.items() for what in ("solved", "agrees")) + " FROM kp"
