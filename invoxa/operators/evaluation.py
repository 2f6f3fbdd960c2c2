"""Phase 3: score final results against ground truth.

Truth and generated results meet on the derived output name
(``X.json`` -> ``X_parsed.json`` on the truth side, ``X.pdf`` ->
``X_parsed.json`` on the generated side): one shuffle join. Scores are
row-local; the overall mean is one partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoxa.functions.jsonish import HEADER_FIELDS

# FIXED VALUES: points per document, order of the report lines, and report texts.
POINTS_TOTAL = 7
REPORT_ORDER = ("invoiceNumber", "invoiceDate", "supplierName", "kvkNumber", "vatNumber")
MARK = "❌"


def truth_key(filename: Column) -> Column:
    return F.replace(filename, F.lit(".json"), F.lit("_parsed.json"))


def generated_key(filename: Column) -> Column:
    return F.replace(filename, F.lit(".pdf"), F.lit("_parsed.json"))


def _py_str(c: Column) -> Column:
    """Python str() of an optional string (None -> 'None')."""
    return F.coalesce(c, F.lit("None"))


def _py_set(arr: Column) -> Column:
    """Set rendering with sorted members: set() / {'a', 'b'}."""
    s = F.sort_array(F.array_distinct(arr))
    return F.when(F.size(s) == 0, F.lit("set()")).otherwise(F.concat(
        F.lit("{"), F.array_join(F.transform(s, lambda x: F.concat(F.lit("'"), x, F.lit("'"))),
                                 ", "), F.lit("}")))


def field_points(gen: Column, tru: Column) -> list[tuple[str, Column]]:
    """(field, scored) per header field. Equality treats two NULLs as equal;
    the supplier also scores when either non-empty name contains the other
    (case-insensitive)."""
    out = []
    for f in HEADER_FIELDS:
        g, t = gen[f], tru[f]
        eq = g.eqNullSafe(t)
        if f == "supplierName":
            both = (F.length(g) > 0) & (F.length(t) > 0)
            lg, lt = F.lower(g), F.lower(t)
            eq = F.when(F.coalesce(both, F.lit(False)),
                        lg.contains(lt) | lt.contains(lg) | eq).otherwise(eq)
        out.append((f, F.coalesce(eq, F.lit(False))))
    return out


def code_set(cases: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(cases, lambda c: c["validatedClientCaseNumber"])))


def evaluate(generated: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per truth file: points, accuracy, report, or missing output.

    Output: truth_file, output_file, evaluated (bool), points, accuracy,
    line_items_ok, no_activity_ok, per-field flags f_<field>, missing_codes,
    unexpected_codes, report (array<string>).

    Both sides are cut down to the sets of codes before the join, so neither line items nor
    repeated codes are shuffled.
    """
    def sets(side: str) -> list[Column]:
        return [F.col("invoiceHeader").alias(f"{side}_header"), code_set(F.col("clientCases")).alias(f"{side}_codes"),
                F.sort_array(F.array_distinct("clientCasesNoActivity")).alias(f"{side}_na")]

    t = truth.select(F.col("filename").alias("truth_file"), truth_key(F.col("filename")).alias("_key"), *sets("t"))
    g = generated.select(generated_key(F.col("filename")).alias("_key"), *sets("g"))
    x = t.join(g, "_key", "left")
    fields = field_points(F.col("g_header"), F.col("t_header"))
    gset, tset = F.col("g_codes"), F.col("t_codes")
    scored = dict(fields)
    cases_ok = gset == tset
    na_ok = F.col("g_na") == F.col("t_na")
    missing = F.array_except(tset, gset)
    extra = F.array_except(gset, tset)
    points = sum((F.when(ok, 1).otherwise(0) for _, ok in fields), F.lit(0)) \
        + F.when(cases_ok, 1).otherwise(0) + F.when(na_ok, 1).otherwise(0)
    reports = [F.when(~ok, F.concat(F.lit(f"{MARK} {f} mismatch: Expected '"),
                                     _py_str(F.col("t_header")[f]), F.lit("', got '"),
                                     _py_str(F.col("g_header")[f]), F.lit("'")))
               for f in REPORT_ORDER for ok in [scored[f]]]
    reports.append(F.when(~cases_ok, F.concat(
        F.lit(f"{MARK} Line Items mismatch. Missing: "), _py_set(missing),
        F.lit(", Unexpected: "), _py_set(extra))))
    reports.append(F.when(~na_ok, F.lit(f"{MARK} NoActivity mismatch.")))
    evaluated = F.col("g_header").isNotNull() | gset.isNotNull()
    return x.select(
        "truth_file", F.col("_key").alias("output_file"), evaluated.alias("evaluated"),
        F.when(evaluated, points).alias("points"),
        F.when(evaluated, (points / F.lit(POINTS_TOTAL)) * 100).alias("accuracy"),
        F.when(evaluated, cases_ok).alias("line_items_ok"),
        F.when(evaluated, na_ok).alias("no_activity_ok"),
        *[F.when(evaluated, ok).alias(f"f_{f}") for f, ok in fields],
        F.when(evaluated, missing).alias("missing_codes"),
        F.when(evaluated, extra).alias("unexpected_codes"),
        F.when(evaluated, F.filter(F.array(*reports), lambda r: r.isNotNull())).alias("report"))


def final_score(scored: DataFrame) -> DataFrame:
    """Mean accuracy over evaluated documents (NULL when none was evaluated)."""
    e = scored.where("evaluated")
    return e.agg(F.count(F.lit(1)).alias("n_evaluated"), F.avg("accuracy").alias("final_score"))


def missing_outputs(scored: DataFrame) -> DataFrame:
    return scored.where(~F.col("evaluated")).select("truth_file", "output_file")


def accuracy_by_field(scored: DataFrame) -> DataFrame:
    """Share of evaluated documents scoring each of the seven points."""
    e = scored.where("evaluated")
    names = [f"f_{f}" for f in HEADER_FIELDS] + ["line_items_ok", "no_activity_ok"]
    stack = "stack({n}, {pairs}) as (field, ok)".format(
        n=len(names), pairs=", ".join(f"'{c}', {c}" for c in names))
    return (e.selectExpr(stack).groupBy("field")
            .agg(F.avg(F.col("ok").cast("double")).alias("accuracy"),
                 F.count(F.lit(1)).alias("n")))
