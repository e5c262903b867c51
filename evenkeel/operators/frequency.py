"""Shape 2: values and their row counts on both sides.

All configured columns are melted to ``(label, family, value)`` in one scan and counted in one
shuffle. The partial aggregate runs before the shuffle, so a value that holds a third of all rows
arrives as one row per task. Nothing per value is ever collected; samples are a bounded top-n.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel import results as R
from evenkeel.functions import values as V
from evenkeel.functions.values import quote
from evenkeel.operators.facts import Facts, Side
from evenkeel.results import FAIL, PASS, WARN, Finding, case, fixed_finding, text

SAMPLE_VALUES = 20


@dataclass(frozen=True)
class Counted:
    """A column whose values (or text lengths) are counted under ``label``."""

    column: str
    kind: str = "value"  # value | length
    limit: int | None = None  # length: declared limit
    mapping: tuple[tuple[Any, Any], ...] | None = None  # value: source value -> target value

    @property
    def label(self) -> str:
        parts = [self.kind, self.column]
        if self.limit is not None:
            parts.append(str(self.limit))
        if self.mapping:
            parts.append(",".join(f"{k}>{v}" for k, v in self.mapping))
        return ":".join(parts)


@dataclass(frozen=True)
class ValueCheck:
    counted: Counted
    decide: Callable[[Facts], Sequence[Finding]]
    samples: bool = False  # whether the rule shows values found on one side only
    relative: bool = False  # whether the rule needs totals of the label (shares, longest target value)


def _key(value: Any) -> str:
    """A Python value as the text a column of the matching family shows."""
    if isinstance(value, bool):
        return f"boolean:{value}"
    if isinstance(value, (int, float)):
        return f"number:{int(value) if float(value).is_integer() else value}"
    return f"text:{value}"


def value_rows(df: DataFrame, counted: Sequence[Counted]) -> DataFrame:
    """``(label, family, value, n)``, one row per non-null value, not yet aggregated."""
    side = Side.of(df)
    structs = []
    for c in dict.fromkeys(counted):
        value = side.text(c.column)
        family = V.type_family(side.dtype(c.column))
        if c.kind == "length":
            value, family = f"CAST(length({value}) AS STRING)", "length"
        structs.append(f"struct({quote(c.label)} AS label, {quote(family)} AS family, {value} AS value)")
    melted = df.selectExpr(f"inline(array({', '.join(structs)}))")
    return melted.where("value IS NOT NULL").selectExpr("label", "family", "value", "1L AS n")


def compact(rows: DataFrame) -> DataFrame:
    """Counts of one batch, for the incremental state."""
    return rows.groupBy("label", "family", "value").agg(F.sum("n").alias("n"))


def paired(source_rows: DataFrame, target_rows: DataFrame) -> DataFrame:
    """``(label, family, value, src_n, tgt_n)``: union with side counts and one shuffle, no join."""
    s = source_rows.selectExpr("label", "family", "value", "n AS src_n", "0L AS tgt_n")
    t = target_rows.selectExpr("label", "family", "value", "0L AS src_n", "n AS tgt_n")
    return s.unionByName(t).groupBy("label", "family", "value").agg(
        F.sum("src_n").alias("src_n"), F.sum("tgt_n").alias("tgt_n")
    )


def _per_label(counted: Sequence[Counted], rule: Callable[[Counted], str], otherwise: str) -> str:
    if not counted:
        return otherwise
    whens = " ".join(f"WHEN label = {quote(c.label)} THEN {rule(c)}" for c in counted)
    return f"CASE {whens} ELSE {otherwise} END"


_COUNTS = {
    "src_total": "sum(src_n)",
    "tgt_total": "sum(tgt_n)",
    "src_distinct": "count_if(src_n > 0)",
    "tgt_distinct": "count_if(tgt_n > 0)",
    "src_only_values": "count_if(_src_bad)",
    "src_only_rows": "sum(CASE WHEN _src_bad THEN src_n ELSE 0L END)",
    "tgt_only_values": "count_if(_tgt_bad)",
    "tgt_only_rows": "sum(CASE WHEN _tgt_bad THEN tgt_n ELSE 0L END)",
    "expected_seen": "count_if(_hit)",
    # at most as many as the mapping has; also lets Spark aggregate by hash, without a sort by label
    "seen": "collect_set(CASE WHEN _hit THEN value END)",
    "src_max_length": "max(CASE WHEN family = 'length' AND src_n > 0 THEN CAST(value AS INT) END)",
    "tgt_max_length": "max(CASE WHEN family = 'length' AND tgt_n > 0 THEN CAST(value AS INT) END)",
}

# these depend on totals of the whole label
_RELATIVE = {
    "max_shift": "max(_shift)",
    "max_shift_value": "min(struct(-_shift AS g, value AS v)).v",
    "exceeding": "sum(CASE WHEN family = 'length' AND try_cast(value AS INT) > _limit THEN src_n ELSE 0L END)",
}


def _flagged(pairs: DataFrame, counted: Sequence[Counted]) -> DataFrame:
    """Mark values that one side should not have, and mapped values that were found."""
    mapped = [c for c in counted if c.mapping]

    def listed(values) -> str:
        return V.is_any("concat(family, ':', value)", [_key(v) for v in values])

    def keys(c):
        return listed(k for k, _ in c.mapping)

    def expected(c):
        return listed(v for _, v in c.mapping)

    return pairs.selectExpr(
        "*",
        _per_label(mapped, lambda c: f"(src_n > 0 AND NOT {keys(c)})", "(src_n > 0 AND tgt_n = 0)") + " AS _src_bad",
        _per_label(mapped, lambda c: f"(tgt_n > 0 AND NOT {expected(c)})", "(tgt_n > 0 AND src_n = 0)") + " AS _tgt_bad",
        _per_label(mapped, lambda c: f"(tgt_n > 0 AND {expected(c)})", "false") + " AS _hit",
    )


def _with_totals(flagged: DataFrame, counted: Sequence[Counted]) -> DataFrame:
    """Add the shift of every value's share and the length limit; the totals are one row per column."""
    limits = [c for c in counted if c.limit is not None]
    totals = flagged.groupBy("label").agg(
        F.expr("sum(src_n)").alias("_src_total"),
        F.expr("sum(tgt_n)").alias("_tgt_total"),
        F.expr(f"coalesce({_COUNTS['tgt_max_length']}, 0)").alias("_tgt_max"),
    )
    return flagged.join(F.broadcast(totals), "label").selectExpr(
        "*",
        _per_label(limits, lambda c: str(c.limit), "_tgt_max") + " AS _limit",
        "abs(coalesce(try_divide(src_n, _src_total), 0D) - coalesce(try_divide(tgt_n, _tgt_total), 0D)) AS _shift",
    )


def label_facts(pairs: DataFrame, checks: Sequence[ValueCheck]) -> DataFrame:
    """One row with a struct ``v<i>`` of statistics and an array ``x<i>`` of samples per label."""
    counted = list(dict.fromkeys(c.counted for c in checks))
    labels = [c.label for c in counted]
    flagged = values = _flagged(pairs, counted)
    wanted = dict(_COUNTS)
    if any(c.relative for c in checks):
        values = _with_totals(flagged, counted)
        wanted |= _RELATIVE
    stats = values.groupBy("label").agg(*[F.expr(sql).alias(name) for name, sql in wanted.items()])
    rows = stats.selectExpr("label", f"struct({', '.join(wanted)}) AS v", "CAST(NULL AS STRING) AS x")
    if any(c.samples for c in checks):
        # The rank filter runs before the shuffle too, so each task sends at most SAMPLE_VALUES per group.
        # The side is a product so that no part of the test moves below the counts: then all readers of
        # the counts are equal plans and Spark computes them once.
        side = "IF(family = 'length', 0, 1) * CASE WHEN _src_bad THEN 1 WHEN _tgt_bad THEN 2 ELSE 0 END"
        differing = (
            flagged.selectExpr("label", "family", "value", f"{side} AS _side")
            .where("_side > 0")
            .selectExpr(
                "label", "_side", "value",
                "row_number() OVER (PARTITION BY label, _side ORDER BY value, family) AS _rank",
            )
            .where(f"_rank <= {SAMPLE_VALUES}")
            .selectExpr("label", "concat(IF(_side = 1, 'source: ', 'target: '), value) AS x")
        )
        rows = rows.unionByName(differing, allowMissingColumns=True)
    return rows.selectExpr(
        *[f"first(CASE WHEN label = {quote(label)} THEN v END, true) AS v{i}" for i, label in enumerate(labels)],
        *[f"sort_array(collect_list(CASE WHEN label = {quote(label)} THEN x END)) AS x{i}" for i, label in enumerate(labels)],
    )


def value_check_rows(pairs: DataFrame, checks: Sequence[ValueCheck], table: str, run_id: str = "") -> DataFrame:
    labels = list(dict.fromkeys(c.counted.label for c in checks))
    scope = R.Scope()
    found = [f for c in checks for f in c.decide(ValueFacts(str(labels.index(c.counted.label)), scope))]
    return R.rows(label_facts(pairs, checks), found, table, run_id, scope)


class ValueFacts(Facts):
    """Statistics of one label; counts are 0 where a column holds no value at all."""

    _KEEP_NULL = ("src_max_length", "max_shift", "max_shift_value")

    def __call__(self, name: str) -> str:
        if name == "samples":
            return f"x{self.struct}"
        field = f"v{self.struct}.{name}"
        if name == "seen":
            return f"coalesce({field}, array())"
        return field if name in self._KEEP_NULL else self.let(f"coalesce({field}, 0)")


# --- the checks ------------------------------------------------------------------------------


def plan_enum(column: str, mapping: Mapping[Any, Any] | None = None) -> ValueCheck:
    pairs = tuple(mapping.items()) if mapping else None
    expected = len({_key(v) for _, v in pairs}) if pairs else 0

    def decide(get):
        lost, extra = get("src_only_values"), get("tgt_only_values")
        absent = get.let(f"{expected} - {get('expected_seen')}") if pairs else "0"
        wanted = ", ".join(quote(text_) for text_ in sorted({_key(v).split(":", 1)[1] for _, v in pairs or ()}))
        unseen = f"concat_ws(',', array_except(array({wanted}), {get('seen')}))" if pairs else "''"
        status = case((f"{lost} > 0 OR {extra} > 0 OR {absent} > 0", FAIL), otherwise=PASS)
        if pairs:
            message = text(
                "%d source values without a mapping (%d rows), %d mapped values not in the target, "
                "%d unexpected target values (%d rows)",
                lost, get("src_only_rows"), absent, extra, get("tgt_only_rows"),
            )
        else:
            message = text(
                "%d values only in the source (%d rows), %d only in the target (%d rows)",
                lost, get("src_only_rows"), extra, get("tgt_only_rows"),
            )
        return [
            Finding(
                "enum", "enum_mapped" if pairs else "enum", column, status, message,
                {
                    "src_distinct": get("src_distinct"), "tgt_distinct": get("tgt_distinct"),
                    "src_only_values": lost, "src_only_rows": get("src_only_rows"),
                    "tgt_only_values": extra, "tgt_only_rows": get("tgt_only_rows"),
                    "expected_missing": absent,
                },
                {
                    "mapping": quote(",".join(f"{k}->{v}" for k, v in pairs or ())),
                    "expected_missing_values": unseen,
                    # the differing values as a whole: value_differences
                    "samples_cut": f"IF({lost} > {SAMPLE_VALUES} OR {extra} > {SAMPLE_VALUES}, 'yes', 'no')",
                },
                samples=get("samples"),
            )
        ]

    return ValueCheck(Counted(column, mapping=pairs), decide, samples=True)


def plan_distribution(column: str, tolerance: float = 0.05, mapping: Mapping[Any, Any] | None = None) -> ValueCheck:
    """``mapping`` only names the enum check to share the counts with; shares are of the raw values."""
    counted = Counted(column, mapping=tuple(mapping.items()) if mapping else None)
    limit = quote(float(tolerance))

    def decide(get):
        src, tgt, shift, value = (get(n) for n in ("src_total", "tgt_total", "max_shift", "max_shift_value"))
        none = f"{src} = 0 OR {tgt} = 0"
        status = case((none, WARN), (f"{shift} > {limit}", WARN), otherwise=PASS)
        message = (
            f"CASE WHEN {none} THEN 'a side holds no value'"
            f" ELSE {text('largest shift %.4f, category %s', shift, value)} END"
        )
        metrics = {"max_shift": shift, "tolerance": limit, "src_total": src, "tgt_total": tgt}
        return [Finding("enum", "distribution", column, status, message, metrics, {"max_shift_value": value})]

    return ValueCheck(counted, decide, relative=True)


def plan_truncation(column: str, max_length: int | None = None) -> ValueCheck:
    def decide(get):
        n, src_max, tgt_max, over = (get(x) for x in ("src_total", "src_max_length", "tgt_max_length", "exceeding"))
        limit = tgt_max if max_length is None else str(max_length)
        if max_length is not None and max_length <= 0:
            over = "0L"
        status = case(
            (f"{n} = 0", WARN),
            (f"{over} > 0 OR ({tgt_max} = 0 AND {src_max} > 0)", FAIL),
            (f"{src_max} > {tgt_max}", WARN),
            otherwise=PASS,
        )
        message = (
            f"CASE WHEN {n} = 0 THEN 'the source holds no value' ELSE "
            + text(
                "%d of %d source values are longer than %d (longest: source %d, target %d)",
                over, n, limit, src_max, tgt_max,
            )
            + " END"
        )
        metrics = {
            "src_max_length": src_max, "tgt_max_length": tgt_max, "effective_limit": limit,
            "rows_exceeding_limit": over, "src_values": n,
        }
        return [Finding("string", "truncation", column, status, message, metrics)]

    return ValueCheck(Counted(column, "length", max_length), decide, relative=True)


def missing_columns(
    source: Sequence[str], target: Sequence[str], column: str, category: str, check: str
) -> Finding | None:
    absent = [w for w, names in (("source", source), ("target", target)) if column not in names]
    if not absent:
        return None
    message = f"column '{column}' is missing from the {' and '.join(absent)}"
    return fixed_finding(category, check, column, FAIL, message)


def _run(source: DataFrame, target: DataFrame, check: ValueCheck, category: str, name: str, table: str) -> DataFrame:
    absent = missing_columns(source.columns, target.columns, check.counted.column, category, name)
    if absent:
        return R.fixed(source.sparkSession, [absent], table)
    pairs = paired(value_rows(source, [check.counted]), value_rows(target, [check.counted]))
    return value_check_rows(pairs, [check], table)


def value_counts(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Every value of the column with its row counts and shares on both sides."""
    counted = Counted(column)
    pairs = paired(value_rows(source, [counted]), value_rows(target, [counted]))
    totals = pairs.groupBy("label").agg(F.sum("src_n").alias("_s"), F.sum("tgt_n").alias("_t"))
    return pairs.join(F.broadcast(totals), "label").selectExpr(
        "value", "src_n", "tgt_n",
        "coalesce(try_divide(src_n, _s), 0D) AS src_share", "coalesce(try_divide(tgt_n, _t), 0D) AS tgt_share",
    )


def value_differences(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Values found on one side only: ``(value, side, rows)``."""
    counted = Counted(column)
    pairs = paired(value_rows(source, [counted]), value_rows(target, [counted]))
    return pairs.where("src_n = 0 OR tgt_n = 0").selectExpr(
        "value", "CASE WHEN tgt_n = 0 THEN 'source' ELSE 'target' END AS side", "src_n + tgt_n AS rows"
    )


def check_enum_equivalence(
    source: DataFrame, target: DataFrame, column: str, table: str, mapping: Mapping[Any, Any] | None = None
) -> DataFrame:
    """Distinct values of both sides, as they are or through a declared mapping."""
    return _run(source, target, plan_enum(column, mapping), "enum", "enum_mapped" if mapping else "enum", table)


def check_categorical_distribution(
    source: DataFrame, target: DataFrame, column: str, table: str, tolerance: float = 0.05
) -> DataFrame:
    """WARN where the share of a value moves by more than ``tolerance``."""
    return _run(source, target, plan_distribution(column, tolerance), "enum", "distribution", table)


def check_string_truncation(
    source: DataFrame, target: DataFrame, column: str, table: str, max_length: int | None = None
) -> DataFrame:
    """Source values longer than the declared limit or, without one, than the longest target value."""
    return _run(source, target, plan_truncation(column, max_length), "string", "truncation", table)
