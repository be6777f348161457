"""Joins (J1-J13).  All equi-joins: Spark picks broadcast-hash / shuffle-hash /
sort-merge, AQE re-plans at runtime and splits skewed partitions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators._keys import all_of, dedupe_by_key, key_pairs, keyed_left_join
from tablewright.operators.filters import where

# Fall-back join keys in priority order (business key names).
DEFAULT_KEY_PRIORITY = ("MATNR", "MANDT", "KUNNR", "LIFNR", "WERKS", "LGORT", "BUKRS")

_JOIN_TYPES = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}


@dataclass(frozen=True)
class JoinCondition:
    left_table: str
    right_table: str
    left_field: str
    right_field: str
    join_type: str = "INNER"


class CrossJoinRefused(ValueError):
    pass


def common_key(a_cols: Sequence[str], b_cols: Sequence[str],
               priority: Sequence[str] = DEFAULT_KEY_PRIORITY) -> str | None:
    """First priority key present in both schemas; else the first shared
    column; else None."""
    shared = [c for c in a_cols if c in set(b_cols)]
    for k in priority:
        if k in shared:
            return k
    return shared[0] if shared else None


def join_tables_spec(tables: Mapping[str, DataFrame], conditions: Sequence[JoinCondition] = (),
                     allow_cross: bool = False, key_priority: Sequence[str] = DEFAULT_KEY_PRIORITY
                     ) -> DataFrame:
    """Star join from the first table: every later table joins the first on
    all conditions naming both (either direction; a composite key has several),
    with their type (unknown -> INNER); without one, on the common key (J2); without that, a CROSS JOIN
    only when ``allow_cross`` (J3).  Each table is aliased by its name so
    ``F.col("<table>.<col>")`` selects owner-qualified columns (J4)."""
    names = list(tables)
    main = names[0]
    stray = [c for c in conditions if main not in (c.left_table, c.right_table)
             or not {c.left_table, c.right_table} <= set(names)]
    if stray:
        raise ValueError(f"conditions must name {main} and another table of the join: {stray}")
    out = tables[main].alias(main)
    for name in names[1:]:
        right = tables[name].alias(name)
        pair = [c for c in conditions if {c.left_table, c.right_table} == {main, name}]
        if pair:
            hows = {_JOIN_TYPES.get(str(c.join_type).upper(), "inner") for c in pair}
            if len(hows) > 1:
                raise ValueError(f"conditions of {main} and {name} name different join types: {sorted(hows)}")
            fields = [(c.left_field, c.right_field) if c.left_table == main else (c.right_field, c.left_field) for c in pair]
            out = out.join(right, all_of([F.col(f"{main}.{lf}") == F.col(f"{name}.{rf}") for lf, rf in fields]), hows.pop())
            continue
        k = common_key(tables[main].columns, tables[name].columns, key_priority)
        if k is not None:
            out = out.join(right, F.col(f"{main}.{k}") == F.col(f"{name}.{k}"), "inner")
        elif allow_cross:
            out = out.crossJoin(right)
        else:
            raise CrossJoinRefused(f"no join key between {main} and {name}; pass allow_cross=True")
    return out


def select_qualified(df: DataFrame, fields: Sequence[str | tuple[str, str]]) -> DataFrame:
    """``"table.col"`` or ``("table.col", alias)``; default alias ``col``."""
    cols = []
    for f in fields:
        src, alias = (f, f.split(".")[-1]) if isinstance(f, str) else f
        cols.append(F.col(src).alias(alias))
    return df.select(*cols)


def cross(a: DataFrame, b: DataFrame) -> DataFrame:
    """Explicit, opt-in cartesian product."""
    return a.crossJoin(b)


def join_insert(target: DataFrame, tables: Mapping[str, DataFrame], conditions: Sequence[JoinCondition],
                mapping: Mapping[str, str], conds=None) -> DataFrame:
    """``INSERT INTO target SELECT t1.a, t2.b FROM t1 JOIN t2 ON .. WHERE
    t2.f IN (..)``; ``mapping`` target col -> qualified source col."""
    from tablewright.operators.mutate import insert_select
    joined = where(join_tables_spec(tables, conditions), conds)
    return insert_select(target, joined, {k: F.col(v) for k, v in mapping.items()})


def join_update(target: DataFrame, tables: Mapping[str, DataFrame], conditions: Sequence[JoinCondition],
                key, columns: Mapping[str, str], conds=None) -> DataFrame:
    """Update the target by key from the joined sources (CTE ``joined_data``)."""
    from tablewright.operators.mutate import update_from
    pairs = key_pairs(key)
    joined = where(join_tables_spec(tables, conditions), conds)
    flat = joined.select(*[F.col(sk).alias(f"__tw_jk{i}") for i, (_, sk) in enumerate(pairs)],
                         *[F.col(v).alias(f"__tw_jv{i}") for i, v in enumerate(columns.values())])
    return update_from(target, flat, [(tk, f"__tw_jk{i}") for i, (tk, _) in enumerate(pairs)],
                       {t: f"__tw_jv{i}" for i, t in enumerate(columns)})


def join_lookup(target: DataFrame, key, t1: DataFrame, t2: DataFrame, t3: DataFrame,
                t1_t2: tuple[str, str], t2_t3: tuple[str, str], t1_key: str,
                result: Mapping[str, str]) -> DataFrame:
    """``SET cols = (SELECT t3.cols FROM t1 JOIN t2 ON .. JOIN t3 ON .. WHERE
    t1.key = target.key)``: unmatched target rows become NULL (scalar-subquery
    semantics, S1), several matches -> smallest tuple."""
    chain = (t1.alias("t1").join(t2.alias("t2"), F.col(f"t1.{t1_t2[0]}") == F.col(f"t2.{t1_t2[1]}"))
             .join(t3.alias("t3"), F.col(f"t2.{t2_t3[0]}") == F.col(f"t3.{t2_t3[1]}")))
    flat = chain.select(F.col(f"t1.{t1_key}").alias("__tw_k"),
                        *[F.col(v if "." in v else f"t3.{v}").alias(f"__tw_r{i}") for i, v in enumerate(result.values())])
    flat = dedupe_by_key(flat, ["__tw_k"], [f"__tw_r{i}" for i in range(len(result))])
    (tk, _), = key_pairs(key)
    joined = keyed_left_join(target, flat, [(tk, "__tw_k")], flag=None)
    names = list(result)
    cols = [F.col(f"__tw_r{names.index(c)}").alias(c) if c in result else F.col(c) for c in target.columns]
    cols += [F.col(f"__tw_r{i}").alias(n) for i, n in enumerate(names) if n not in target.columns]
    return joined.select(*cols)


def cross_segment(main: DataFrame, segments: Mapping[str, DataFrame], key: str | None = None,
                  fields: Mapping[str, Sequence[str]] | None = None, allow_cross: bool = False,
                  key_priority: Sequence[str] = DEFAULT_KEY_PRIORITY,
                  key_mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Enrich the main target with columns of earlier segment targets by LEFT
    JOIN on the common key (J2), or on ``key_mapping`` (J13: main column ->
    segment column, e.g. ``{"PRODUCT": "MATNR"}``).  Each segment is first
    reduced to one row per key (smallest tuple) so the main table's row count
    never changes."""
    out = main
    for name, seg in segments.items():
        mk = sk = None
        if key_mapping:
            mk, sk = next(((m, s_) for m, s_ in key_mapping.items() if m in main.columns and s_ in seg.columns),
                          (None, None))
        if mk is None:
            mk = sk = key or common_key(main.columns, seg.columns, key_priority)
        cols = list((fields or {}).get(name) or [c for c in seg.columns if c != sk and c not in out.columns])
        if mk is None:
            if not allow_cross:
                raise CrossJoinRefused(f"no common key with segment {name}")
            out = out.crossJoin(seg.select(*cols))
            continue
        reduced = dedupe_by_key(seg.select(sk, *cols), [sk], cols)
        reduced = reduced.select(sk, *[F.col(c).alias(f"{name}_{c}") if c in out.columns else F.col(c) for c in cols])
        out = keyed_left_join(out, reduced, [(mk, sk)], flag=None)
    return out


def copy_from_previous(target: DataFrame, previous: DataFrame, source: DataFrame, key: str | tuple[str, str],
                       field: str, dst: str) -> DataFrame:
    """``INSERT INTO target (dst) SELECT t2.field FROM previous t1 JOIN source
    t2 ON t1.k = t2.k``."""
    from tablewright.operators.mutate import insert_select
    (pk, sk), = key_pairs(key)
    joined = previous.select(F.col(pk).alias("__tw_pk")).join(
        source, F.col("__tw_pk") == source[sk], "inner")
    return insert_select(target, joined, {dst: F.col(field)})


def _key_side(df: DataFrame, other: DataFrame, key, other_conds):
    """Only the (renamed) key columns of the filtered other side: column pruning
    reaches its scan and a self-join cannot confuse the two sides."""
    pairs = key_pairs(key)
    ref = where(other, other_conds).select(*[F.col(b).alias(f"__tw_s{i}") for i, (_, b) in enumerate(pairs)])
    return ref, all_of([df[a] == F.col(f"__tw_s{i}") for i, (a, _) in enumerate(pairs)])


def semi_exists(df: DataFrame, other: DataFrame, key, other_conds=None) -> DataFrame:
    """J10 core: rows of ``df`` whose key EXISTS in ``other`` (filtered) -- a left
    semi join: the build side keeps only distinct keys, no row multiplication."""
    return df.join(*_key_side(df, other, key, other_conds), "left_semi")


def anti_exists(df: DataFrame, other: DataFrame, key, other_conds=None) -> DataFrame:
    """Rows of ``df`` whose key does NOT exist in ``other`` (left anti).
    NULL keys never match, so they are kept, as ``NOT EXISTS`` does."""
    return df.join(*_key_side(df, other, key, other_conds), "left_anti")


def insert_where_exists(target: DataFrame, source: DataFrame, other: DataFrame, key,
                        mapping: Mapping[str, str], conds=None, other_conds=None) -> DataFrame:
    """``INSERT INTO target SELECT t1.f FROM t1 WHERE filter AND EXISTS
    (SELECT 1 FROM t2 WHERE t2.k = t1.k AND t2.v = ..)``."""
    from tablewright.operators.mutate import insert_select
    rows = semi_exists(where(source, conds), other, key, other_conds)
    return insert_select(target, rows, mapping)


def add_fields(main: DataFrame, other: DataFrame, main_key: str, other_key: str,
               fields: Sequence[str], assume_unique: bool = False) -> DataFrame:
    """Left join bringing only the chosen fields (``other`` reduced to one
    row per key so ``main`` keeps its row count)."""
    reduced = dedupe_by_key(other.select(other_key, *fields), [other_key], list(fields), assume_unique=assume_unique)
    return keyed_left_join(main, reduced, [(main_key, other_key)], flag=None)


def join_on_mapping(a: DataFrame, b: DataFrame, key_mapping: Sequence[Mapping[str, str]] | Mapping[str, str],
                    how: str = "inner") -> DataFrame:
    """Join where the key carries different names on each side, given as
    ``[{"target_col": "PRODUCT", "source_col": "MATNR"}, ...]`` (a = target side)."""
    if isinstance(key_mapping, Mapping):
        pairs = list(key_mapping.items())
    else:
        pairs = [(m["target_col"], m["source_col"]) for m in key_mapping]
    return a.join(b, all_of([a[t] == b[s] for t, s in pairs]), how)


# The documented helper name.
join_tables = add_fields
