"""Key checks, validation rules and profiles."""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field
from typing import Any, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tablewright.functions.text import regexp_match
from tablewright.operators._keys import keyed_left_join
from tablewright.operators.aggs import summary


class KeyRejected(ValueError):
    pass


# ---------------------------------------------------------------- K1-K4

def key_check(df: DataFrame, column: str) -> DataFrame:
    """K1+K2 in one pass over the data: one row ``(key, rows, null_count,
    duplicate_groups)``; duplicate groups are values seen more than once, NULL
    left out.  The per-value count is a partial (map-side) aggregate, so a hot
    value is combined before the shuffle."""
    per_value = df.groupBy(F.col(column).alias("__tw_v")).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg(
        F.lit(column).alias("key"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("__tw_v").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("null_count"),
        F.count_if(F.col("__tw_v").isNotNull() & (F.col("n") > 1)).cast("long").alias("duplicate_groups"))


def assert_key(df: DataFrame, column: str, distinct: bool = False) -> DataFrame:
    """K3: refuse a column as key when it holds NULLs or duplicates -- unless
    DISTINCT was asked for, in which case the distinct non-NULL values are
    returned.  Otherwise returns ``df`` unchanged."""
    if distinct:
        return df.select(column).where(F.col(column).isNotNull()).distinct()
    r = key_check(df, column).first()
    if r["null_count"] or r["duplicate_groups"]:
        raise KeyRejected(f"{column} contains null values and/or duplicate entries "
                          f"({r['null_count']} nulls, {r['duplicate_groups']} duplicate values)")
    return df


# Key-name markers tried in order when choosing a key column.
KEY_MARKERS = ("MATNR", "ID", "KEY", "NR", "CODE", "NUM")


def choose_key(target_cols: Sequence[str], source_cols: Sequence[str],
               key_mapping: Sequence[Mapping[str, str]] | None = None) -> tuple[str, str] | None:
    """K4: (target key, source key): the key mapping first; else the first common
    column containing MATNR, ID, KEY, NR, CODE, NUM (in that order); else the
    first common column; else None."""
    for m in key_mapping or []:
        if m.get("target_col") in target_cols and m.get("source_col") in source_cols:
            return m["target_col"], m["source_col"]
    common = [c for c in target_cols if c in set(source_cols)]
    for marker in KEY_MARKERS:
        for c in common:
            if marker in c.upper():
                return c, c
    return (common[0], common[0]) if common else None


# ---------------------------------------------------------------- V1-V7

@dataclass(frozen=True)
class Rule:
    field: str
    rule_type: str
    parameters: Mapping[str, Any] = dc_field(default_factory=dict)


VALID = "Valid"


def _rule_expr(df: DataFrame, rule: Rule, idx: int) -> tuple[DataFrame, Column]:
    c = F.col(rule.field)
    p = dict(rule.parameters or {})
    t = rule.rule_type
    if t == "not_null":
        return df, F.when(c.isNull(), F.lit("Invalid: Null value")).otherwise(F.lit(VALID))
    if t == "unique":
        # Duplicate values found by an aggregate (one row per value) joined back:
        # no window over a hot value's whole partition.
        dups = (df.where(c.isNotNull()).groupBy(c.alias(f"__tw_u{idx}"))
                .agg(F.count(F.lit(1)).alias("__tw_n")).where(F.col("__tw_n") > 1)
                .select(f"__tw_u{idx}"))
        flag = f"__tw_dup{idx}"
        df = keyed_left_join(df, dups, [(rule.field, f"__tw_u{idx}")], flag=flag)
        return df, (F.when(c.isNull(), F.lit("Invalid: Null value"))
                    .when(F.col(flag).isNotNull(), F.lit("Invalid: Duplicate value"))
                    .otherwise(F.lit(VALID)))
    if t == "range":
        # Text is compared as a number where the bounds are numbers; text that is none has no range to leave.
        bounds = [b for b in (p.get("min"), p.get("max")) if b is not None]
        as_number = isinstance(df.schema[rule.field].dataType, StringType) and any(isinstance(b, (int, float)) for b in bounds)
        number = c.try_cast("double") if as_number else c
        conds = []
        if p.get("min") is not None:
            conds.append(number < F.lit(p["min"]))
        if p.get("max") is not None:
            conds.append(number > F.lit(p["max"]))
        if not conds:
            return df, F.lit(VALID)
        bad = conds[0] if len(conds) == 1 else conds[0] | conds[1]
        return df, F.when(bad, F.lit("Invalid: Out of range")).otherwise(F.lit(VALID))
    if t == "regex":
        pat = p.get("pattern")
        if not pat:
            return df, F.lit(VALID)
        ok = regexp_match(pat, c)   # Python dialect, search anywhere, NULL / bad pattern -> False
        return df, F.when(~ok, F.lit("Invalid: Pattern mismatch")).otherwise(F.lit(VALID))
    if t == "exists_in":
        ref, ref_field = p.get("reference_table"), p.get("reference_field")
        if ref is None or not ref_field:
            return df, F.lit(VALID)
        refs = ref.select(F.col(ref_field).alias(f"__tw_r{idx}")).where(F.col(f"__tw_r{idx}").isNotNull()).distinct()
        flag = f"__tw_ex{idx}"
        df = keyed_left_join(df, refs, [(rule.field, f"__tw_r{idx}")], flag=flag)
        return df, F.when(F.col(flag).isNull(), F.lit("Invalid: Reference not found")).otherwise(F.lit(VALID))
    return df, F.lit(f"Unknown validation rule: {t}")


def validate(df: DataFrame, rules: Sequence[Rule | Mapping[str, Any]],
             fields: Sequence[str] | None = None) -> DataFrame:
    """V1-V7: one ``validation_result_<i>`` column per rule (1-based), then the
    insertion ``fields`` (default: the rules' fields), as one select.

    Rule types: ``not_null``, ``unique``, ``range`` (min/max inclusive, NULL
    valid), ``regex`` (search; NULL invalid), ``exists_in`` (``reference_table``
    DataFrame + ``reference_field``; NULL invalid); others give
    ``'Unknown validation rule: <type>'``.  Checks needing other rows (unique,
    exists_in) are joins against aggregated/distinct keys, never windows."""
    rules = [r if isinstance(r, Rule) else Rule(r["field"], r["rule_type"], r.get("parameters", {}))
             for r in rules]
    rules = [r for r in rules if r.field and r.rule_type]
    out = df
    exprs = []
    for i, r in enumerate(rules):
        out, e = _rule_expr(out, r, i)
        exprs.append(e.alias(f"validation_result_{i + 1}"))
    cols = list(fields) if fields else list(dict.fromkeys(r.field for r in rules))
    return out.select(*exprs, *[F.col(c) for c in cols])


# ---------------------------------------------------------------- V8-V11

def check_result(target: DataFrame, result: DataFrame, expected_columns: Sequence[str]) -> DataFrame:
    """V8: one row: target rows >= result rows, and the result's populated
    columns are exactly the expected ones.  Both tables feed one aggregate
    (tagged union), so there is no join at all."""
    cols = result.columns
    tagged = target.select(F.lit(1).alias("__t"), *[F.lit(None).cast(result.schema[c].dataType).alias(c) for c in cols]) \
        .unionByName(result.select(F.lit(0).alias("__t"), *[F.col(f"`{c}`") for c in cols]))
    row = tagged.agg(F.sum("__t").alias("target_rows"), F.sum(1 - F.col("__t")).alias("result_rows"),
                     *[F.count(F.col(f"`{c}`")).alias(c) for c in cols])
    pop = F.filter(F.array(*[F.when(F.col(f"`{c}`") > 0, F.lit(c)) for c in cols]), lambda x: x.isNotNull()) \
        if cols else F.array().cast("array<string>")
    pop = F.array_sort(pop)
    exp = sorted(expected_columns)
    return row.select(
        F.coalesce("target_rows", F.lit(0)).alias("target_rows"), F.coalesce("result_rows", F.lit(0)).alias("result_rows"),
        (F.coalesce("target_rows", F.lit(0)) >= F.coalesce("result_rows", F.lit(0))).alias("rows_ok"),
        pop.alias("populated_columns"),
        (pop == F.array(*[F.lit(c) for c in exp]).cast("array<string>")).alias("columns_ok"))


def missing_mandatory(target: DataFrame, meta: DataFrame) -> DataFrame:
    """V9: mandatory fields (``isMandatory = 'True'``) of the metadata that have
    no non-NULL value in the target (absent columns count as empty)."""
    s = summary(target).select(F.explode("non_null").alias("field", "n"))
    mand = meta.where(F.col("isMandatory") == "True").select(F.col("fields").alias("field")).distinct()
    filled = s.where(F.col("n") > 0).select("field")
    return mand.join(filled, "field", "left_anti")


def profile(df: DataFrame, exact_distinct: bool = True, quantiles: Sequence[float] = ()) -> DataFrame:
    """One row per column: type, rows, nulls, distinct, min, max and (for
    numbers) mean/stddev; with ``quantiles``, numbers also get ``quantiles``, an
    array in that order.

    Plain statistics and sketches are one aggregate that is combined in each task
    (HyperLogLog++ and quantile summaries merge).  ``exact_distinct`` counts
    exactly instead: every column is unpivoted to (position, value hash of 128 bits),
    duplicates go in each task, and one shuffle counts what is left; rows are not
    expanded once a column with all inputs, as mixed distinct aggregates would.
    Otherwise distinct counts are off by ``DISTINCT_ERROR`` (standard deviation)."""
    fields = df.schema.fields
    plain = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        comparable = f.dataType.typeName() not in ("array", "map", "struct", "variant", "binary")
        numeric = isinstance(f.dataType, NumericType)
        plain += [F.count(c).alias(f"__nn{i}"),
                  (F.min(c).cast("string") if comparable else F.lit(None).cast("string")).alias(f"__mn{i}"),
                  (F.max(c).cast("string") if comparable else F.lit(None).cast("string")).alias(f"__mx{i}"),
                  (F.avg(c) if numeric else F.lit(None).cast("double")).alias(f"__avg{i}"),
                  (F.stddev_samp(c) if numeric else F.lit(None).cast("double")).alias(f"__sd{i}")]
        if quantiles:
            plain.append((F.percentile_approx(c.cast("double"), list(quantiles)) if numeric else F.lit(None).cast("array<double>")).alias(f"__q{i}"))
        if not exact_distinct:
            plain.append(F.approx_count_distinct(c, DISTINCT_ERROR).alias(f"__d{i}"))
    stats = df.agg(*plain).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("type"), F.col("__rows").alias("rows"),
                 (F.col("__rows") - F.col(f"__nn{i}")).alias("nulls"),
                 (F.lit(None) if exact_distinct else F.col(f"__d{i}")).cast("long").alias("distinct"),
                 F.col(f"__mn{i}").alias("min"), F.col(f"__mx{i}").alias("max"),
                 F.col(f"__avg{i}").alias("mean"), F.col(f"__sd{i}").alias("stddev"),
                 *([F.col(f"__q{i}").alias("quantiles")] if quantiles else []))
        for i, f in enumerate(fields)])).alias("p")).select("p.*")
    if not exact_distinct:
        return stats
    values = F.array(*[F.struct(F.lit(i).alias("position"), _digest(F.col(f"`{f.name}`")).alias("v")) for i, f in enumerate(fields)])
    dist = (df.select(F.inline(values)).where(F.col("v").isNotNull()).distinct()
            .groupBy("position").agg(F.count(F.lit(1)).alias("distinct")))
    none = stats.select("position", F.lit(0).cast("long").alias("distinct"))  # columns without a value
    merged = stats.unionByName(dist.unionByName(none), allowMissingColumns=True)
    keep = ["column", "type", "rows", "nulls", "distinct", "min", "max", "mean", "stddev", *(["quantiles"] if quantiles else [])]
    first = lambda k: F.first(k, ignorenulls=True) if k == "quantiles" else F.max(k)
    return merged.groupBy("position").agg(*[first(k).alias(k) for k in keep])


#: Relative standard deviation of approximate distinct counts.
DISTINCT_ERROR = 0.02


def _digest(c: Column) -> Column:
    """A value as text of fixed length, so that wide values are not shuffled;
    equal values of a column have equal digests, and two others meet with a
    chance of 2^-128.  NULL stays NULL."""
    return F.when(c.isNotNull(), F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b")))


def find_relationships(tables: Mapping[str, DataFrame], min_cover: float = 1.0,
                       pairs: Sequence[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Column pairs (child table.col -> parent table.col) whose distinct
    non-NULL child values are contained in the parent's values at least
    ``min_cover`` (1.0 = inclusion dependency).  Candidate pairs are columns of
    the same type in different tables, or the given ``pairs``.

    All pairs are found at once by inverted values: each table is read once and
    unpivoted to (type, value, bit of the column), and each value's bits are joined,
    in every task first, so no value is hot.  That is the set of the columns that
    hold it; equal sets are counted, and pairs come from the few distinct sets.  One
    shuffle of distinct values, whatever the number of pairs."""
    spark = next(iter(tables.values())).sparkSession
    cols = [(t, f.name, f.dataType.simpleString()) for t, d in tables.items() for f in d.schema.fields
            if isinstance(f.dataType, (NumericType, StringType)) and f.dataType.typeName() not in ("float", "double")]
    known = {(t, c): i for i, (t, c, _) in enumerate(cols)}
    if pairs is None:
        pairs = [(a, ac, b, bc) for a, ac, at in cols for b, bc, bt in cols if a != b and at == bt]
        kinds = [kind for _, _, kind in cols]
    else:
        # Pairs that the caller names are compared as text where their types differ.
        for t, c in {x for a, ac, b, bc in pairs for x in ((a, ac), (b, bc))}:
            if (t, c) not in known:
                known[t, c] = len(cols)
                cols.append((t, c, tables[t].schema[c].dataType.simpleString()))
        apart = {x for a, ac, b, bc in pairs if cols[known[a, ac]][2] != cols[known[b, bc]][2] for x in ((a, ac), (b, bc))}
        group = _groups([((a, ac), (b, bc)) for a, ac, b, bc in pairs])
        kinds = [("string" if any(y in apart for y in group.get((t, c), ())) else kind) for t, c, kind in cols]
    used = {known[x] for a, ac, b, bc in pairs for x in ((a, ac), (b, bc))}
    schema = "child_table string, child_column string, parent_table string, parent_column string, child_distinct long, covered long, cover double"
    if not used:
        return spark.createDataFrame([], schema)
    words = [f"m{w}" for w in range(1 + max(used) // _BITS)]
    values = None
    for t, d in tables.items():
        mine = [i for i in sorted(used) if cols[i][0] == t]
        if not mine:
            continue
        rows = d.select(F.inline(F.array(*[F.struct(
            F.lit(kinds[i]).alias("kind"), F.col(f"`{cols[i][1]}`").cast("string").alias("v"),
            *(F.lit(1 << i % _BITS if w == i // _BITS else 0).cast("long").alias(m) for w, m in enumerate(words))) for i in mine])))
        rows = rows.where(F.col("v").isNotNull())
        values = rows if values is None else values.unionByName(rows)
    sets = (values.groupBy("kind", "v").agg(*(F.bit_or(m).alias(m) for m in words))
            .groupBy(*words).agg(F.count(F.lit(1)).alias("n")))

    def holds(i: Column) -> Column:
        word = F.element_at(F.array(*words), F.floor(i / _BITS).cast("int") + 1)
        return F.get(F.lit([1 << x for x in range(_BITS)]), i % _BITS).bitwiseAND(word) != 0
    wanted = spark.createDataFrame([(known[a, ac], known[b, bc], a, ac, b, bc) for a, ac, b, bc in pairs],
                                   "c int, p int, child_table string, child_column string, parent_table string, parent_column string")
    # The catalogue's pairs, not the data: bounded by the square of the columns.
    held = sets.select(F.explode(F.filter(F.lit(sorted(used)), holds)).alias("c"), *words, "n").join(F.broadcast(wanted), "c")
    out = held.groupBy("child_table", "child_column", "parent_table", "parent_column").agg(
        F.sum("n").alias("child_distinct"), F.sum(F.when(holds(F.col("p")), F.col("n")).otherwise(0)).alias("covered"))
    out = out.withColumn("cover", F.col("covered") / F.col("child_distinct"))
    return out.where(F.col("cover") >= F.lit(min_cover))


#: Columns that one 64-bit set holds.
_BITS = 62


def _groups(links: Sequence[tuple]) -> dict:
    """Node -> all nodes of its connected group (the caller's column pairs)."""
    group: dict = {}
    for a, b in links:
        both = group.get(a, {a}) | group.get(b, {b})
        for x in both:
            group[x] = both
    return group
