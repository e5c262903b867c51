"""The registered queries as plain SQL over the same tables, written independently of the operators."""

from __future__ import annotations

# --- derived targets, as in evenkeel.plans.targets ---------------------------------------------

ORDERS = """src AS (SELECT * FROM orders),
tgt AS (
  SELECT o_orderkey,
    CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS o_custkey,
    CASE WHEN o_orderkey % 41 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice,
    o_orderdate + INTERVAL 60 MINUTE AS o_orderdate,
    CASE WHEN o_orderkey % 29 = 0 AND o_orderkey % 31 = 0 THEN left('  ' || o_orderpriority || '  ', 6)
         WHEN o_orderkey % 29 = 0 THEN left(o_orderpriority, 6)
         WHEN o_orderkey % 31 = 0 THEN '  ' || o_orderpriority || '  ' ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 97 <> 0
)"""

REPEATED = ORDERS + """,
rep AS (
  SELECT o_orderkey, copy, o_custkey, o_orderstatus, o_totalprice,
    CASE WHEN o_orderkey % 53 = 0 THEN 'not-a-date' WHEN o_orderkey % 59 = 0 THEN ''
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_day
  FROM (SELECT *, 0 AS copy FROM tgt UNION ALL SELECT *, 1 AS copy FROM tgt WHERE o_orderkey % 101 = 0)
)"""

LINEITEM = """lsrc AS (SELECT * FROM lineitem),
ltgt AS (
  SELECT CASE WHEN l_orderkey % 43 = 0 THEN l_orderkey + 10000000 ELSE l_orderkey END AS l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
    l_extendedprice, round(l_discount, 1) AS l_discount
  FROM lineitem
)"""

DOCUMENTS = """dsrc AS (SELECT * FROM documents),
dtgt AS (
  SELECT doc_id,
    CASE WHEN doc_id % 23 = 0 THEN 'Ã©' || text WHEN doc_id % 19 = 0 THEN left(text, 500)
         WHEN doc_id % 17 = 0 THEN text || chr(9) ELSE text END AS text,
    lang, source
  FROM documents
)"""

EVENTS = """esrc AS (SELECT * FROM events),
etgt AS (
  SELECT event_id,
    CASE WHEN event_id % 29 = 0 THEN ts + INTERVAL 7 MINUTE ELSE ts END AS ts,
    CASE WHEN event_id % 13 = 0 THEN -1 ELSE user_id END AS user_id,
    CASE WHEN event_id % 7 = 0 THEN 'view' ELSE event_type END AS event_type,
    CASE WHEN event_id % 47 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value
  FROM events
)"""

LABELS = """bsrc AS (SELECT * FROM labels),
btgt AS (
  SELECT doc_id,
    CASE WHEN doc_id % 11 = 0 THEN 'maybe' WHEN doc_id % 5 = 0 THEN 'no' WHEN quality = 1 THEN 'Y' ELSE 'N' END AS quality,
    CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END AS toxic
  FROM labels
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _row(table: str, check: str, column: str | None, status: str, **values: str) -> str:
    """One SELECT list in the form of the flat result rows."""
    name = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    extra = "".join(f", {sql} AS {alias}" for alias, sql in values.items())
    return f"SELECT '{table}' AS table_name, '{check}' AS \"check\", {name} AS \"column\", {status} AS status{extra}"


def _n(sql: str) -> str:
    return f"CAST({sql} AS BIGINT)"


def _r(sql: str, digits: int = 4) -> str:
    return f"round(CAST({sql} AS DOUBLE), {digits})"


def _union(*parts: str) -> str:
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


# --- parts that several queries use ---------------------------------------------------------------

_COUNTS = "(SELECT (SELECT count(*) FROM {s}) AS a, (SELECT count(*) FROM {t}) AS b)"


def _volume(table: str, s: str, t: str, tolerance: float, extra: bool = True) -> str:
    loss = "abs(a - b) * 100.0 / a"
    status = f"CASE WHEN a = 0 AND b = 0 THEN 'PASS' WHEN a = 0 THEN 'WARN' WHEN {loss} <= {tolerance} THEN 'PASS' ELSE 'FAIL' END"
    values = {"src_rows": _n("a"), "tgt_rows": _n("b"), "difference": _n("abs(a - b)"), "loss_pct": _r(loss)} if extra else {}
    return _row(table, "volume", None, status, **values) + " FROM " + _COUNTS.format(s=s, t=t)


def _identity(table: str, key: str, s: str = "src", t: str = "tgt", extra: bool = True) -> str:
    facts = (
        f"(SELECT (SELECT count(DISTINCT {key}) FROM {s}) AS sk, (SELECT count(DISTINCT {key}) FROM {t}) AS tk,"
        f" (SELECT count(*) FROM {s} WHERE {key} IS NULL) AS sn, (SELECT count(*) FROM {t} WHERE {key} IS NULL) AS tn,"
        f" (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {s} WHERE {key} IS NOT NULL INTERSECT SELECT DISTINCT {key} FROM {t})) AS common)"
    )
    pct = "common * 100.0 / sk"
    status = f"CASE WHEN {pct} >= 95 THEN 'PASS' WHEN common > 0 THEN 'WARN' ELSE 'FAIL' END"
    values = {
        "common_keys": _n("common"), "src_keys": _n("sk"), "tgt_keys": _n("tk"), "src_null_keys": _n("sn"),
        "tgt_null_keys": _n("tn"), "overlap_pct": _r(pct),
    }
    return _row(table, "identity", key, status, **(values if extra else {})) + " FROM " + facts


_SQL_AGG = {
    "sum": "sum({c})", "avg": "avg({c})", "max": "max({c})", "min": "min({c})", "variance": "var_samp({c})",
}


def _drift(table: str, kind: str, column: str, s: str, t: str, label: str | None = None, other: str | None = None,
           tolerance: float = 1.0, digits: int | None = 2, extra: bool = True) -> str:
    # sums and averages over decimals, so that the order of addition does not matter
    def value(side: str, c: str) -> str:
        x = f"CAST({c} AS DECIMAL(18,4))" if kind in ("sum", "avg") else c
        agg = f"CAST(sum({x}) AS DOUBLE) / count({c})" if kind == "avg" else _SQL_AGG[kind].format(c=x)
        return f"(SELECT CAST({agg} AS DOUBLE) FROM {side})"

    facts = f"(SELECT {value(s, column)} AS a, {value(t, other or column)} AS b)"
    pct = "abs(a - b) / abs(a) * 100"
    noise = " <= 1e-7" if kind == "variance" else " = 0"
    status = f"CASE WHEN a = 0 THEN 'WARN' WHEN {pct}{noise} THEN 'PASS' WHEN {pct} <= {tolerance} THEN 'WARN' ELSE 'FAIL' END"
    values = {}
    if extra:
        if digits is not None:
            values = {"src_value": _r("a", digits), "tgt_value": _r("b", digits)}
        values["pct_difference"] = _r(pct)
    return _row(table, kind, label or column, status, **values) + " FROM " + facts


def _allowed(table: str, side: str, columns: list[str], values: list[str], extra: bool = True) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    bad = " + ".join(
        f"count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS VARCHAR) NOT IN ({listed}))" for c in columns
    )
    return (
        _row(table, "allowed_values", ",".join(columns), "CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END",
             **({"invalid_rows": _n("n")} if extra else {}))
        + f" FROM (SELECT {bad} AS n FROM {side})"
    )


def _fk(table: str, child: str, fk: str, parent: str, pk: str, extra: bool = True) -> str:
    orphan = f"{fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {parent})"
    facts = (
        f"(SELECT count(*) FILTER (WHERE {orphan}) AS o, count(DISTINCT {fk}) FILTER (WHERE {orphan}) AS k,"
        f" count(*) FILTER (WHERE {fk} IS NULL) AS n, count(*) AS r FROM {child})"
    )
    values = {"orphaned_count": _n("o"), "orphaned_keys": _n("k"), "null_count": _n("n"), "child_rows": _n("r")}
    status = "CASE WHEN r = 0 THEN 'WARN' WHEN o = 0 AND n = 0 THEN 'PASS' ELSE 'FAIL' END"
    return _row(table, "foreign_key", fk, status, **(values if extra else {})) + " FROM " + facts


def _sentinel(table: str, column: str, s: str, t: str, listed: str, extra: bool = True) -> str:
    def side(name: str, p: str) -> str:
        return (
            f"(SELECT count(*) AS {p}r, count(*) FILTER (WHERE {column} IS NULL) AS {p}n,"
            f" count(*) FILTER (WHERE {column} IS NULL OR {column} IN ({listed})) AS {p}b FROM {name})"
        )

    before, after = "abs(1.0 * sn / sr - 1.0 * tn / tr) < 0.001", "abs(1.0 * sb / sr - 1.0 * tb / tr) < 0.001"
    status = f"CASE WHEN {before} AND {after} THEN 'PASS' WHEN {before} OR {after} THEN 'WARN' ELSE 'FAIL' END"
    values = {
        "src_sentinel_substitutions": _n("sb - sn"), "tgt_sentinel_substitutions": _n("tb - tn"),
        "src_null_rate_before": _r("100.0 * sn / sr"), "tgt_null_rate_before": _r("100.0 * tn / tr"),
        "src_null_rate_after": _r("100.0 * sb / sr"), "tgt_null_rate_after": _r("100.0 * tb / tr"),
    }
    return _row(table, "null_sentinel", column, status, **(values if extra else {})) + f" FROM {side(s, 's')}, {side(t, 't')}"


def _constraint(table: str, side: str, column: str, broken: str, names: list[str], extra: bool = True) -> str:
    values = {"rows": _n("r"), **{n: _n("b") for n in names}} if extra else {}
    status = "CASE WHEN r = 0 THEN 'WARN' WHEN b > 0 THEN 'FAIL' ELSE 'PASS' END"
    return _row(table, "constraint", column, status, **values) + (
        f" FROM (SELECT count(*) AS r, count(*) FILTER (WHERE {broken}) AS b FROM {side})"
    )


def _unique(table: str, column: str, s: str, t: str, extra: bool = True) -> str:
    def side(name: str, p: str) -> str:
        return f"(SELECT count({column}) AS {p}c, count(DISTINCT {column}) AS {p}d FROM {name})"

    status = "CASE WHEN sc = 0 THEN 'WARN' WHEN 1.0 * td / tc < 1.0 * sd / sc - 0.001 THEN 'FAIL' ELSE 'PASS' END"
    values = {
        "src_unique_count": _n("sd"), "tgt_unique_count": _n("td"),
        "src_unique_ratio": _r("1.0 * sd / sc"), "tgt_unique_ratio": _r("1.0 * td / tc"),
    }
    return _row(table, "uniqueness", column, status, **(values if extra else {})) + f" FROM {side(s, 's')}, {side(t, 't')}"


def _truncation(table: str, column: str, s: str, t: str, limit: int | None, extra: bool = True) -> str:
    cap = str(limit) if limit is not None else f"(SELECT coalesce(max(length({column})), 0) FROM {t})"
    facts = (
        f"(SELECT (SELECT max(length({column})) FROM {s}) AS sm, (SELECT coalesce(max(length({column})), 0) FROM {t}) AS tm,"
        f" {cap} AS cap, (SELECT count(*) FROM {s} WHERE length({column}) > {cap}) AS o,"
        f" (SELECT count({column}) FROM {s}) AS n)"
    )
    status = "CASE WHEN n = 0 THEN 'WARN' WHEN o > 0 OR (tm = 0 AND sm > 0) THEN 'FAIL' WHEN sm > tm THEN 'WARN' ELSE 'PASS' END"
    values = {
        "src_max_length": _n("sm"), "tgt_max_length": _n("tm"), "effective_limit": _n("cap"),
        "rows_exceeding_limit": _n("o"), "src_values": _n("n"),
    }
    return _row(table, "truncation", column, status, **(values if extra else {})) + " FROM " + facts


_BLANK = r"[ \t\n\r\v\f\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _pair_counts(table: str, check: str, column: str, s: str, t: str, broken: str, status: str, **values: str) -> str:
    def side(name: str, p: str) -> str:
        return f"(SELECT count({column}) AS {p}n, count(*) FILTER (WHERE {broken}) AS {p}b FROM {name})"

    return _row(table, check, column, status, **values) + f" FROM {side(s, 's')}, {side(t, 't')}"


def _whitespace(table: str, column: str, s: str, t: str, extra: bool = True) -> str:
    broken = f"regexp_matches(left({column}, 1) || right({column}, 1), '{_BLANK}')"
    status = "CASE WHEN sn = 0 THEN 'WARN' WHEN sb > 0 AND tb = 0 THEN 'WARN' WHEN tb > sb THEN 'FAIL' ELSE 'PASS' END"
    values = {
        "src_unstripped_count": _n("sb"), "tgt_unstripped_count": _n("tb"),
        "src_unstripped_pct": _r("100.0 * sb / sn"), "tgt_unstripped_pct": _r("100.0 * tb / tn"),
    }
    return _pair_counts(table, "whitespace", column, s, t, broken, status, **(values if extra else {}))


def _encoding(table: str, column: str, s: str, t: str, extra: bool = True) -> str:
    broken = f"regexp_matches({column}, '\\x{{fffd}}|\\x{{c3}}[\\x{{80}}-\\x{{ff}}]')"
    status = "CASE WHEN sn = 0 THEN 'WARN' WHEN tb > sb THEN 'FAIL' WHEN sb > 0 AND tb = 0 THEN 'WARN' ELSE 'PASS' END"
    values = {"src_corrupt_count": _n("sb"), "tgt_corrupt_count": _n("tb")}
    return _pair_counts(table, "encoding", column, s, t, broken, status, **(values if extra else {}))


def _frequencies(column: str, s: str, t: str) -> str:
    return (
        f"(SELECT v, sum(a) AS a, sum(b) AS b, sum(sum(a)) OVER () AS ta, sum(sum(b)) OVER () AS tb FROM"
        f" (SELECT {column} AS v, 1 AS a, 0 AS b FROM {s} WHERE {column} IS NOT NULL"
        f" UNION ALL SELECT {column}, 0, 1 FROM {t} WHERE {column} IS NOT NULL) GROUP BY v)"
    )


def _enum(table: str, column: str, s: str, t: str, extra: bool = True) -> str:
    facts = (
        "(SELECT count(*) FILTER (WHERE a > 0) AS sd, count(*) FILTER (WHERE b > 0) AS td,"
        " count(*) FILTER (WHERE b = 0) AS so, coalesce(sum(a) FILTER (WHERE b = 0), 0) AS sr,"
        f" count(*) FILTER (WHERE a = 0) AS too, coalesce(sum(b) FILTER (WHERE a = 0), 0) AS tr FROM {_frequencies(column, s, t)})"
    )
    values = {
        "src_distinct": _n("sd"), "tgt_distinct": _n("td"), "src_only_values": _n("so"), "src_only_rows": _n("sr"),
        "tgt_only_values": _n("too"), "tgt_only_rows": _n("tr"),
    }
    status = "CASE WHEN so > 0 OR too > 0 THEN 'FAIL' ELSE 'PASS' END"
    return _row(table, "enum", column, status, **(values if extra else {})) + " FROM " + facts


def _distribution(table: str, column: str, s: str, t: str, tolerance: float, extra: bool = True) -> str:
    facts = (
        f"(SELECT v, abs(1.0 * a / ta - 1.0 * b / tb) AS d FROM {_frequencies(column, s, t)} ORDER BY d DESC, v LIMIT 1)"
    )
    values = {"max_shift": _r("d"), "max_shift_value": "v"}
    status = f"CASE WHEN d > {tolerance} THEN 'WARN' ELSE 'PASS' END"
    return _row(table, "distribution", column, status, **(values if extra else {})) + " FROM " + facts


_ZONES = "30,60,90,120,150,180,210,240,270,300,330,345,360,390,420,450,480,510,525,540,570,600,630,660,720,780,840"


def _offset(table: str, column: str, key: str, s: str, t: str, extra: bool = True) -> str:
    facts = (
        "(SELECT count(*) AS n, median(d) AS m, stddev_samp(d) AS sd FROM"
        f" (SELECT round_even((epoch_us(t.{column}) - epoch_us(s.{column})) / 60e6, 0) AS d"
        f" FROM {s} s JOIN {t} t ON s.{key} = t.{key}))"
    )
    status = f"CASE WHEN abs(m) IN ({_ZONES}) AND sd < 5 THEN 'FAIL' WHEN abs(m) > 0 THEN 'WARN' ELSE 'PASS' END"
    values = {
        "rows_analysed": _n("n"), "median_delta_minutes": _r("m"), "median_delta_hours": _r("m / 60"),
        "std_delta_minutes": _r("sd"),
    }
    return _row(table, "tz_offset", column, status, **(values if extra else {})) + " FROM " + facts


def _digits(table: str, column: str, s: str, t: str, precision: int | None = None, scale: int | None = None,
            extra: bool = True) -> str:
    # the shortest decimal form without trailing zeros
    form = f"regexp_replace(regexp_replace(CAST({column} AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
    text = f"CASE WHEN contains(CAST({column} AS VARCHAR), '.') THEN {form} ELSE CAST({column} AS VARCHAR) END"

    def side(name: str, p: str) -> str:
        return (
            f"(SELECT max(CASE WHEN contains(x, '.') THEN length(split_part(x, '.', 2)) ELSE 0 END) AS {p}s,"
            f" max(length(replace(replace(x, '.', ''), '-', ''))) AS {p}p FROM (SELECT {text} AS x FROM {name}))"
        )

    lost_s = "ss > ts" if scale is None else f"(ts < {scale} AND ss > ts)"
    lost_p = "sp > tp" if precision is None else f"(tp < {precision} AND sp > tp)"
    values = {
        "src_max_scale": _n("ss"), "tgt_max_scale": _n("ts"), "src_max_precision": _n("sp"), "tgt_max_precision": _n("tp"),
    }
    status = f"CASE WHEN {lost_s} OR {lost_p} THEN 'FAIL' ELSE 'PASS' END"
    return _row(table, "numeric_precision", column, status, **(values if extra else {})) + f" FROM {side(s, 's')}, {side(t, 't')}"


def _boolean(column: str) -> str:
    def side(name: str, p: str) -> str:
        token = f"trim(CAST({column} AS VARCHAR))"
        return (
            f"(SELECT count(*) FILTER (WHERE {token} IN ('Y', '1', 'True', 'true', 'T', 't', 'yes', 'Yes')) AS {p}t,"
            f" count(*) FILTER (WHERE {token} IN ('N', '0', 'False', 'false', 'F', 'f', 'no', 'No')) AS {p}f,"
            f" count({column}) AS {p}n FROM {name})"
        )

    a, b = "1.0 * st / (st + sf)", "1.0 * tt / (tt + tf)"
    status = f"CASE WHEN abs({a} - {b}) > 0.001 THEN 'FAIL' WHEN sn > st + sf OR tn > tt + tf THEN 'WARN' ELSE 'PASS' END"
    return _row(
        "labels", "boolean", column, status, src_unmapped=_n("sn - st - sf"), tgt_unmapped=_n("tn - tt - tf"),
        src_true_share=_r(a), tgt_true_share=_r(b), share_gap=_r(f"abs({a} - {b})"),
    ) + f" FROM {side('bsrc', 's')}, {side('btgt', 't')}"


def _awareness(table: str, column: str, status: str, src: str, tgt: str, src_tz: str, tgt_tz: str) -> str:
    return _row(table, "tz_awareness", column, f"'{status}'", src_naive=_n(src), tgt_naive=_n(tgt),
                src_tz=f"'{src_tz}'", tgt_tz=f"'{tgt_tz}'")


def _full() -> str:
    """Every check of the orders audit: table, check, column and status."""
    return _union(
        _volume("orders", "src", "tgt", 0.1, extra=False),
        _identity("orders", "o_orderkey", extra=False),
        *[_drift("orders", k, "o_totalprice", "src", "tgt", extra=False) for k in ("sum", "avg", "max", "min", "variance")],
        _allowed("orders", "tgt", ["o_orderstatus"], ["F", "O", "P"], extra=False),
        _fk("orders", "tgt", "o_custkey", "customer", "c_custkey", extra=False),
        _constraint("orders", "tgt", "o_totalprice", "o_totalprice <= 0", [], extra=False),
        _constraint("orders", "tgt", "o_custkey", "o_custkey IS NULL", [], extra=False),
        _truncation("orders", "o_orderpriority", "src", "tgt", None, extra=False),
        _whitespace("orders", "o_orderpriority", "src", "tgt", extra=False),
        _encoding("orders", "o_orderpriority", "src", "tgt", extra=False),
        _enum("orders", "o_orderstatus", "src", "tgt", extra=False),
        _distribution("orders", "o_orderstatus", "src", "tgt", 0.05, extra=False),
        _row("orders", "tz_awareness", "o_orderdate", "'PASS'"),
        _offset("orders", "o_orderdate", "o_orderkey", "src", "tgt", extra=False),
        _sentinel("orders", "o_custkey", "src", "tgt", "0, -1", extra=False),
        _digits("orders", "o_totalprice", "src", "tgt", extra=False),
        _unique("orders", "o_orderkey", "src", "tgt", extra=False),
    )


_SECTION = """CASE "check" WHEN 'volume' THEN 'Data Volume Checks' WHEN 'identity' THEN 'Identity Checks'
 WHEN 'sum' THEN 'Aggregate Checks' WHEN 'avg' THEN 'Aggregate Checks' WHEN 'max' THEN 'Aggregate Checks'
 WHEN 'min' THEN 'Aggregate Checks' WHEN 'variance' THEN 'Aggregate Checks'
 WHEN 'allowed_values' THEN 'Mapping Checks' WHEN 'foreign_key' THEN 'Relationship Checks'
 WHEN 'constraint' THEN 'Data Constraint Checks' WHEN 'uniqueness' THEN 'Data Constraint Checks'
 WHEN 'truncation' THEN 'String Data Quality Checks' WHEN 'whitespace' THEN 'String Data Quality Checks'
 WHEN 'encoding' THEN 'String Data Quality Checks' WHEN 'enum' THEN 'Enum & Categorical Checks'
 WHEN 'distribution' THEN 'Enum & Categorical Checks' WHEN 'tz_awareness' THEN 'Datetime & Timezone Checks'
 WHEN 'tz_offset' THEN 'Datetime & Timezone Checks' WHEN 'null_sentinel' THEN 'Null & Sentinel Value Checks'
 WHEN 'numeric_precision' THEN 'Numeric Precision Checks' END"""

_STATUS_COUNTS = ", ".join(
    f"CAST(count(*) FILTER (WHERE status = '{s}') AS BIGINT) AS n_{s.lower()}" for s in ("PASS", "WARN", "FAIL", "ERROR")
)
_VERDICT = (
    "CASE WHEN count(*) = 0 THEN 'NO-GO' WHEN count(*) FILTER (WHERE status = 'ERROR') > 0 THEN 'ERROR'"
    " WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'NO-GO'"
    " WHEN count(*) FILTER (WHERE status = 'WARN') > 0 THEN 'GO WITH WARNINGS' ELSE 'GO' END"
)

_BAD_ROWS = """SELECT o_orderkey, copy, concat_ws('; ',
    CASE WHEN o_custkey IS NULL THEN 'o_custkey is null' END,
    CASE WHEN order_day = '' THEN 'order_day is null' END,
    CASE WHEN order_day = 'not-a-date' THEN 'order_day is no date: not-a-date' END{target}) AS _validation_errors
  FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY copy) AS rn FROM rep)"""
_TARGET_REASONS = """,
    CASE WHEN o_orderstatus NOT IN ('F', 'O', 'P') THEN 'o_orderstatus has a value that is not allowed: ' || o_orderstatus END,
    CASE WHEN rn > 1 THEN 'duplicate key in o_orderkey: ' || o_orderkey END"""
_BAD_TARGET = _BAD_ROWS.format(target=_TARGET_REASONS)
_BAD_SOURCE = _BAD_ROWS.format(target="")

_SHARDS = """a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0),
b AS (SELECT o_orderkey, 'B' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0)"""


def _pick(order: str) -> str:
    return (
        _with(_SHARDS)
        + "SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey"
        f" ORDER BY o {order}) AS rn FROM (SELECT *, 0 AS o FROM a UNION ALL SELECT *, 1 AS o FROM b)) WHERE rn = 1"
    )


def _rules() -> str:
    one = "SELECT 'orders' AS table_name, '{side}' AS side, '{rule}' AS rule, CAST(count(*) AS BIGINT) AS rows FROM {frm} WHERE {cond} HAVING count(*) > 0"
    both = [("o_custkey:not_null", "o_custkey IS NULL"), ("order_day:not_null", "order_day = ''"), ("order_day:date", "order_day = 'not-a-date'")]
    parts = [one.format(side=side, rule=r, frm="rep", cond=c) for side in ("source", "target") for r, c in both]
    parts.append(one.format(side="target", rule="o_orderstatus:allowed", frm="rep", cond="o_orderstatus NOT IN ('F', 'O', 'P')"))
    ranked = "(SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY copy) AS rn FROM rep)"
    parts.append(one.format(side="target", rule="o_orderkey:duplicate", frm=ranked, cond="rn > 1"))
    return _with(REPEATED) + _union(*parts)


def _filtered() -> str:
    good = (
        ", good AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY copy) AS rn FROM rep)"
        " WHERE o_custkey IS NOT NULL AND o_orderstatus IN ('F', 'O', 'P') AND rn = 1)"
    )
    return "WITH " + REPEATED + good + "\n" + _union(
        _volume("orders", "src", "good", 0.1, extra=False),
        _identity("orders", "o_orderkey", "src", "good", extra=False),
        _allowed("orders", "good", ["o_orderstatus"], ["F", "O", "P"], extra=False),
        _constraint("orders", "good", "o_custkey", "o_custkey IS NULL", [], extra=False),
        _unique("orders", "o_orderkey", "src", "good", extra=False),
    )


def _inject() -> str:
    rows = """SELECT o_orderkey,
  CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 17 = 0 THEN '  ' || st || '  ' ELSE st END AS o_orderstatus,
  CASE WHEN o_orderkey % 5 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 19 = 0 THEN left(o_orderpriority, 5) || '...' ELSE o_orderpriority END AS o_orderpriority
  FROM (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN 'Z' ELSE o_orderstatus END AS st FROM orders) WHERE o_orderkey % 97 <> 0"""
    return f"WITH f AS ({rows}) SELECT * FROM f UNION ALL SELECT * FROM f WHERE o_orderkey % 23 = 0"


_FULL = _with(ORDERS) + _full()

ALL: dict[str, str] = {
    "volume_1to1": _with(ORDERS) + _volume("orders", "src", "tgt", 0.1),
    "volume_ratio": _row(
        "orders_lineitem", "volume", None, "CASE WHEN abs(b - e) * 100.0 / e <= 1.0 THEN 'PASS' ELSE 'FAIL' END",
        src_rows=_n("a"), tgt_rows=_n("b"), expected_rows=_n("e"), difference=_n("abs(b - e)"),
        loss_pct=_r("abs(b - e) * 100.0 / e"),
    ) + " FROM (SELECT a, b, CAST(floor(a * 3.99) AS BIGINT) AS e FROM " + _COUNTS.format(s="orders", t="lineitem") + ")",
    "identity_overlap": _with(ORDERS) + _identity("orders", "o_orderkey"),
    "identity_null_keys": _with(ORDERS) + _identity("orders", "o_custkey"),
    "missing_keys": _with(ORDERS) + """SELECT coalesce(s.k, t.k) AS key, CASE WHEN t.k IS NULL THEN 'source' ELSE 'target' END AS side,
  CAST(coalesce(s.n, t.n) AS BIGINT) AS rows
  FROM (SELECT o_custkey AS k, count(*) AS n FROM src WHERE o_custkey IS NOT NULL GROUP BY 1) s
  FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM tgt WHERE o_custkey IS NOT NULL GROUP BY 1) t ON s.k = t.k
  WHERE s.k IS NULL OR t.k IS NULL""",
    "schema_diff": _with(ORDERS) + _union(
        _row("orders", "schema_missing_columns", "o_orderpriority", "'FAIL'"),
        _row("orders", "schema_unexpected_columns", "o_year", "'FAIL'"),
        _volume("orders", "src", "tgt", 0.1, extra=False),
        _identity("orders", "o_orderkey", extra=False),
    ),
    **{
        f"agg_{kind}": _with(ORDERS) + _drift("orders", kind, "o_totalprice", "src", "tgt", digits=digits)
        for kind, digits in (("sum", 2), ("avg", 4), ("max", 2), ("min", 2), ("variance", -3))
    },
    "agg_all": _with(LINEITEM) + _union(
        *[
            _drift("lineitem", kind, c, "lsrc", "ltgt", digits=None)
            for c in ("l_quantity", "l_extendedprice", "l_discount")
            for kind in ("sum", "avg", "max", "min", "variance")
            if not (c == "l_discount" and kind == "min")
        ],
        # the smallest discount of the source is zero: there is no percentage
        _row("lineitem", "min", "l_discount", "'WARN'", pct_difference="CAST(NULL AS DOUBLE)"),
    ),
    "agg_all_null": _with(ORDERS) + _union(
        *[_row("orders", k, "o_totalprice", "CASE WHEN count(o_totalprice) > 0 THEN 'WARN' END") + " FROM src" for k in _SQL_AGG]
    ),
    "agg_column_mapping": _with(ORDERS) + _union(
        *[_drift("orders", k, "o_totalprice", "src", "tgt", "o_totalprice->total_price", digits=None) for k in _SQL_AGG]
    ),
    "junk_numeric": _with(EVENTS) + _row("events", "junk_values", "value", "'FAIL'", junk_rows=_n("count(*)"))
    + " FROM etgt WHERE value IS NOT NULL AND try_cast(value AS DOUBLE) IS NULL HAVING count(*) > 0",
    "numeric_precision": _with(LINEITEM) + _union(
        _digits("lineitem", "l_discount", "lsrc", "ltgt"), _digits("lineitem", "l_extendedprice", "lsrc", "ltgt", 8, 2)
    ),
    "allowed_values": _with(ORDERS, EVENTS) + _union(
        _allowed("orders", "tgt", ["o_orderstatus", "o_custkey"], ["F", "O", "P", "1", "2"]),
        _allowed("events", "etgt", ["event_type"], ["click", "error", "purchase", "signup", "view"]),
    ),
    "invalid_values": _with(ORDERS) + """SELECT "column", value, CAST(count(*) AS BIGINT) AS rows FROM (
  SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM tgt
  UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM tgt)
  WHERE value NOT IN ('F', 'O', 'P', '1-URGENT', '2-HIGH') GROUP BY 1, 2""",
    "fk_orphans": _with(ORDERS, LINEITEM) + _union(
        _fk("orders", "tgt", "o_custkey", "customer", "c_custkey"), _fk("lineitem", "ltgt", "l_orderkey", "orders", "o_orderkey")
    ),
    "orphan_keys": _with(LINEITEM) + "SELECT l_orderkey AS key, CAST(count(*) AS BIGINT) AS rows FROM ltgt"
    " WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1",
    "orphan_rows": _with(ORDERS) + "SELECT o_orderkey, o_custkey FROM tgt ANTI JOIN customer ON o_custkey = c_custkey WHERE o_custkey IS NOT NULL",
    "null_sentinel": _with(ORDERS, EVENTS) + _union(
        _sentinel("orders", "o_custkey", "src", "tgt", "0, -1"),
        _sentinel("events", "user_id", "esrc", "etgt", "-1"),
        _sentinel("orders", "o_orderstatus", "src", "tgt", "'X', '?'"),
    ),
    "constraint_not_null": _with(ORDERS) + _union(
        *[_constraint("orders", "tgt", c, f"{c} IS NULL", ["not_null_violations"]) for c in ("o_custkey", "o_totalprice")]
    ),
    "constraint_date": _with(REPEATED)
    + _constraint("orders", "rep", "order_day", "try_cast(order_day AS TIMESTAMP) IS NULL", ["date_violations"]),
    "constraint_positive": _with(ORDERS) + _union(
        _constraint("orders", "(SELECT CASE WHEN o_orderkey % 61 = 0 THEN -o_totalprice ELSE o_totalprice END AS p FROM tgt)",
                    "o_totalprice", "p <= 0", ["positive_violations"]),
        _constraint("orders", "tgt", "o_custkey", "o_custkey <= 0", ["positive_violations"]),
    ),
    "constraint_between": _with(LINEITEM) + _union(
        _constraint("lineitem", "ltgt", "l_quantity", "l_quantity NOT BETWEEN 1 AND 50", ["violations"]),
        _constraint("lineitem", "ltgt", "l_discount", "l_discount NOT BETWEEN 0 AND 0.05", ["violations"]),
    ),
    "uniqueness": _with(REPEATED) + _union(*[_unique("orders", c, "src", "rep") for c in ("o_orderkey", "o_custkey")]),
    "string_truncation": _with(ORDERS, DOCUMENTS, "dcut AS (SELECT left(text, 2000) AS text FROM dtgt)") + _union(
        _truncation("orders", "o_orderpriority", "src", "tgt", 10),
        _truncation("orders", "o_orderpriority", "src", "tgt", None),
        _truncation("documents", "text", "dsrc", "dcut", None),
    ),
    "whitespace": _with(ORDERS, DOCUMENTS) + _union(
        _whitespace("orders", "o_orderpriority", "src", "tgt"), _whitespace("documents", "text", "dsrc", "dtgt")
    ),
    "encoding": _with(DOCUMENTS) + _union(
        _encoding("documents", "text", "dsrc", "dtgt"), _encoding("documents_reversed", "text", "dtgt", "dsrc")
    ),
    "enum_raw": _with(ORDERS, DOCUMENTS) + _union(
        _enum("orders", "o_orderstatus", "src", "tgt"), _enum("documents", "lang", "dsrc", "dtgt")
    ),
    "enum_mapped": _with(ORDERS, "named AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'FINAL' WHEN 'O' THEN 'OPEN' ELSE 'OTHER' END AS v FROM tgt)")
    + _row(
        "orders", "enum_mapped", "o_orderstatus", "CASE WHEN so > 0 OR too > 0 OR e > 0 THEN 'FAIL' ELSE 'PASS' END",
        src_only_values=_n("so"), src_only_rows=_n("sr"), tgt_only_values=_n("too"), tgt_only_rows=_n("tr"), expected_missing=_n("e"),
    ) + """ FROM (SELECT count(DISTINCT o_orderstatus) AS so, count(*) AS sr FROM src WHERE o_orderstatus NOT IN ('F', 'O', 'X')),
  (SELECT count(DISTINCT v) AS too, count(*) AS tr FROM named WHERE v NOT IN ('FINAL', 'OPEN', 'LOST')),
  (SELECT 3 - count(DISTINCT v) AS e FROM named WHERE v IN ('FINAL', 'OPEN', 'LOST'))""",
    "distribution_shift": _with(EVENTS, ORDERS) + _union(
        _distribution("events", "event_type", "esrc", "etgt", 0.05), _distribution("orders", "o_orderstatus", "src", "tgt", 0.05)
    ),
    "value_counts": _with(ORDERS) + "SELECT v AS value, CAST(a AS BIGINT) AS src_n, CAST(b AS BIGINT) AS tgt_n,"
    f" round(1.0::DOUBLE * a / ta, 6) AS src_share, round(1.0::DOUBLE * b / tb, 6) AS tgt_share FROM {_frequencies('o_orderpriority', 'src', 'tgt')}",
    "value_differences": _with(ORDERS) + "SELECT v AS value, CASE WHEN b = 0 THEN 'source' ELSE 'target' END AS side,"
    f" CAST(a + b AS BIGINT) AS rows FROM {_frequencies('o_orderpriority', 'src', 'tgt')} WHERE a = 0 OR b = 0",
    "boolean_ratio": _with(LABELS) + _union(_boolean("quality"), _boolean("toxic")),
    "datetime_parse": _with(REPEATED) + _row(
        "orders", "datetime_parse", "order_day", "'FAIL'", src_parse_failures=_n("0"), tgt_parse_failures=_n("count(*)")
    ) + " FROM rep WHERE order_day IS NOT NULL AND try_cast(order_day AS TIMESTAMP) IS NULL HAVING count(*) > 0",
    "tz_awareness": _with(ORDERS, EVENTS) + _union(
        _awareness("orders", "o_orderdate", "PASS", "(SELECT count(o_orderdate) FROM src)", "(SELECT count(o_orderdate) FROM tgt)", "naive", "naive"),
        _awareness("orders_utc", "o_orderdate", "WARN", "(SELECT count(o_orderdate) FROM src)", "(SELECT count(o_orderdate) FROM tgt)", "naive", "naive"),
        _awareness("events", "ts", "FAIL", "(SELECT count(ts) FROM esrc)", "0", "naive", "UTC"),
        _awareness("orders_text", "stamp", "FAIL", "0", "0", "UTC", "mixed"),
        _awareness("orders_text_utc", "stamp", "PASS", "0", "0", "UTC", "UTC"),
    ),
    "tz_offset": _with(ORDERS, EVENTS) + _union(
        _offset("orders", "o_orderdate", "o_orderkey", "src", "tgt"), _offset("events", "ts", "event_id", "esrc", "etgt")
    ),
    "tz_offset_repeated_keys": _with(ORDERS) + _offset("orders", "o_orderdate", "o_custkey", "src", "tgt"),
    "quarantine_rows": _with(REPEATED) + f"SELECT * FROM ({_BAD_TARGET}) WHERE _validation_errors <> ''",
    "quarantine_source_rows": _with(REPEATED) + f"SELECT * FROM ({_BAD_SOURCE}) WHERE _validation_errors <> ''",
    "valid_rows": _with(REPEATED) + "SELECT o_orderkey, copy, o_orderstatus, order_day FROM (SELECT *, row_number() OVER"
    " (PARTITION BY o_orderkey ORDER BY copy) AS rn FROM rep) WHERE rn = 1 AND o_custkey IS NOT NULL"
    " AND order_day NOT IN ('', 'not-a-date') AND o_orderstatus IN ('F', 'O', 'P')",
    "quarantine_summary": _with(REPEATED) + f"SELECT 'orders' AS table_name, 'target' AS side, CAST(count(*) AS BIGINT) AS rows FROM ({_BAD_TARGET})"
    f" WHERE _validation_errors <> '' UNION ALL SELECT 'orders', 'source', CAST(count(*) AS BIGINT) FROM ({_BAD_SOURCE}) WHERE _validation_errors <> ''",
    "rule_summary": _rules(),
    "duplicate_pk": _with(REPEATED) + "SELECT o_orderkey, copy, o_custkey FROM (SELECT *, row_number() OVER"
    " (PARTITION BY o_custkey ORDER BY o_orderkey, copy) AS rn FROM rep WHERE o_custkey IS NOT NULL) WHERE rn > 1",
    "filtered_audit": _filtered(),
    "merge_n_to_1": _with(_SHARDS) + "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(NULL AS VARCHAR) AS origin FROM a"
    " UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, 'b' FROM b",
    "sum_n_to_1": _with(_SHARDS) + """SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus,
  round(coalesce(a.o_totalprice, 0) + coalesce(b.o_totalprice, 0), 2) AS o_totalprice FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
    "count_n_to_1": _with(_SHARDS) + "SELECT o_orderkey, CAST(count(*) AS BIGINT) AS count FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1",
    "first_n_to_1": _pick("ASC"),
    "last_n_to_1": _pick("DESC"),
    "join_1_to_n": """SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, l.o_custkey, l.o_totalprice, r.o_orderstatus, r.o_orderpriority
  FROM (SELECT * FROM orders WHERE o_orderkey % 83 <> 0) l FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 89 <> 0) r
  ON l.o_orderkey = r.o_orderkey""",
    "union_1_to_n": _with(ORDERS) + _union(
        _volume("orders", "src", "tgt", 0.1, extra=False), _identity("orders", "o_orderkey", extra=False),
        *[_drift("orders", k, "o_totalprice", "src", "tgt", extra=False) for k in _SQL_AGG],
    ),
    "reshard_n_to_m": _with(ORDERS) + _union(
        _volume("orders", "src", "src", 0.1, extra=False), _identity("orders", "o_orderkey", "src", "src", extra=False),
        *[_drift("orders", k, "o_totalprice", "src", "src", extra=False) for k in _SQL_AGG],
    ),
    "column_rename": "SELECT c_custkey AS id, c_name, c_acctbal AS balance FROM customer",
    "mask_columns": "SELECT c_custkey, sha256(c_name) AS c_name, sha256(CAST(c_nationkey AS VARCHAR)) AS c_nationkey, c_mktsegment FROM customer",
    "redact_text": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Password: hunter' || doc_id || ' ' || text ELSE text END AS text FROM documents),
  r AS (SELECT doc_id, regexp_replace(text, '(password|secret|token|key|pwd)[\\s\\v]*[:=][\\s\\v]*[''"]?([^''"\\s\\v]+)[''"]?', '\\1: [REDACTED]', 'gi') AS text FROM d)
  SELECT doc_id, sha256(text) AS text_hash, CAST(length(text) AS INTEGER) AS chars FROM r""",
    "inject_faults": _inject(),
    "offending_values": _with(ORDERS) + "SELECT o_orderkey, o_orderstatus FROM tgt WHERE o_orderstatus = 'X' ORDER BY o_orderkey LIMIT 5",
    "csv_scan": _with(REPEATED) + """SELECT CASE WHEN o_orderstatus = 'X' THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CAST(count(*) AS BIGINT) AS rows, CAST(sum(o_custkey) AS BIGINT) AS custkeys, round(sum(o_totalprice), 2) AS price,
  CAST(count(nullif(order_day, '')) AS BIGINT) AS days, 'bigint' AS custkey_type, 'string' AS day_type FROM rep GROUP BY 1""",
    "approximate_identity": _with(ORDERS) + """SELECT CAST(s AS BIGINT) AS src_keys, CAST(t AS BIGINT) AS tgt_keys, CAST(c AS BIGINT) AS common_keys,
  round(100.0::DOUBLE * c / s, 4) AS overlap_pct FROM (SELECT (SELECT count(DISTINCT o_custkey) FROM src) AS s, (SELECT count(DISTINCT o_custkey) FROM tgt) AS t,
  (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM src WHERE o_custkey IS NOT NULL INTERSECT SELECT DISTINCT o_custkey FROM tgt)) AS c)""",
    "full_audit": _FULL,
    "incremental_audit": _FULL,
    "verdict": f"SELECT {_VERDICT} AS verdict, CAST(count(*) AS BIGINT) AS total_checks, {_STATUS_COUNTS},"
    f" {_VERDICT} IN ('GO', 'GO WITH WARNINGS') AS allowed FROM ({_FULL})",
    "section_verdicts": f"SELECT {_SECTION} AS section, CASE max(CASE status WHEN 'ERROR' THEN 3 WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END)"
    f" WHEN 3 THEN 'ERROR' WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS section_verdict, CAST(count(*) AS BIGINT) AS checks, {_STATUS_COUNTS}"
    f" FROM ({_FULL}) GROUP BY 1",
    "table_summary": f"SELECT table_name, CAST(count(*) AS BIGINT) AS checks, {_STATUS_COUNTS} FROM ({_FULL}) GROUP BY 1",
    "ci_summary": f"SELECT {_VERDICT} AS verdict, {_STATUS_COUNTS}, '2024-01-01T00:00:00+00:00' AS timestamp, CAST(count(*) AS BIGINT) AS total_checks FROM ({_FULL})",
    "result_fingerprint": "SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS content_hash, CAST(count(*) AS BIGINT) AS results FROM"
    " (SELECT concat_ws('|', table_name, \"check\", coalesce(\"column\", ''), status) AS line FROM (" + _FULL + "))",
    "failing_rows": _with(ORDERS) + _union(
        *[
            f"SELECT '{check}' AS \"check\", '{column}' AS \"column\", 'target' AS side, CAST(o_orderkey AS VARCHAR) AS key,"
            f" CAST({column} AS VARCHAR) AS value FROM tgt WHERE {broken} ORDER BY o_orderkey LIMIT 5"
            for check, column, broken in (
                ("whitespace", "o_orderpriority", f"regexp_matches(left(o_orderpriority, 1) || right(o_orderpriority, 1), '{_BLANK}')"),
                ("allowed_values", "o_orderstatus", "o_orderstatus NOT IN ('F', 'O', 'P')"),
                ("constraint", "o_custkey", "o_custkey IS NULL"),
            )
        ]
    ),
    "custom_checks": _with(ORDERS) + _union(
        _volume("orders", "src", "tgt", 0.1, extra=False),
        _constraint("orders", "tgt", "o_totalprice", "o_totalprice NOT BETWEEN 1000 AND 400000", [], extra=False),
        _whitespace("orders", "o_orderpriority", "src", "tgt", extra=False),
    ),
    "split_shards": "SELECT CAST(o_orderkey % 4 AS INTEGER) AS shard, CAST(count(*) AS BIGINT) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys"
    " FROM orders GROUP BY 1",
}

_KEYS = ("doc_id", "vec_id", "event_id", "user_id")

ALL |= {
    "csv_bad_lines": "SELECT 'orders' AS table_name, 'csv_lines' AS \"check\", CAST(NULL AS VARCHAR) AS \"column\", 'ERROR' AS status,"
    " count(*) FILTER (WHERE o_orderkey % 20 = 0) AS long_lines, CAST(0 AS BIGINT) AS stray_quotes, CAST(NULL AS BIGINT) AS src_rows,"
    " CAST(NULL AS BIGINT) AS tgt_rows FROM orders UNION ALL SELECT 'orders', 'volume', NULL, 'PASS', NULL, NULL, count(*),"
    " count(*) FILTER (WHERE o_orderkey % 20 <> 0) FROM orders",
    "csv_stray_quote": "SELECT 'orders' AS table_name, 'csv_lines' AS \"check\", CAST(NULL AS VARCHAR) AS \"column\", 'WARN' AS status,"
    " CAST(0 AS BIGINT) AS long_lines, count(*) FILTER (WHERE o_orderkey % 30 = 0) AS stray_quotes, CAST(NULL AS BIGINT) AS src_rows,"
    " CAST(NULL AS BIGINT) AS tgt_rows FROM orders UNION ALL SELECT 'orders', 'volume', NULL, 'PASS', NULL, NULL, count(*), count(*) FROM orders",
    "identity_wide_numbers": "SELECT 'orders' AS table_name, 'identity' AS \"check\", 'k' AS \"column\","
    " CASE WHEN 100.0 * c / s >= 95 THEN 'PASS' WHEN c > 0 THEN 'WARN' ELSE 'FAIL' END AS status, c AS common_keys, s AS src_keys, t AS tgt_keys FROM ("
    "SELECT count(DISTINCT k) AS s, count(DISTINCT CAST(CAST(k AS DOUBLE) AS HUGEINT)) AS t,"
    " count(DISTINCT k) FILTER (WHERE k IN (SELECT CAST(CAST(9007199254740992 + o_orderkey AS DOUBLE) AS HUGEINT) FROM orders)) AS c"
    " FROM (SELECT 9007199254740992 + o_orderkey AS k FROM orders))",
    # 15 x 10^-n has n digits behind the point
    "tiny_digits": "SELECT 'orders' AS table_name, 'numeric_precision' AS \"check\", 'x' AS \"column\", 'FAIL' AS status,"
    " CAST(max(o_orderkey % 25) AS BIGINT) AS src_max_scale, CAST(0 AS BIGINT) AS tgt_max_scale FROM orders",
    "id_columns": "SELECT table_name, column_name AS \"column\", column_name IN ("
    + ", ".join(f"'{k}'" for k in _KEYS)
    + ") AS is_key FROM (" + " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, column_name FROM (DESCRIBE {name})" for name in ("documents", "embeddings", "events", "orders", "customer")
    ) + ")",
    "load_errors": "SELECT * FROM (VALUES ('whole', 'volume', NULL, 'PASS'), ('whole', 'identity', 'c_custkey', 'PASS'),"
    " ('absent', 'load', NULL, 'ERROR'), ('unnamed', 'load', NULL, 'ERROR')) AS found(table_name, \"check\", \"column\", status)",
    "chosen_tables": "SELECT * FROM (VALUES ('part', 'volume', NULL, 'PASS'), ('part', 'identity', 'p_partkey', 'PASS'),"
    " ('supplier', 'volume', NULL, 'PASS'), ('supplier', 'identity', 's_suppkey', 'PASS')) AS found(table_name, \"check\", \"column\", status)",
    "input_guard": "SELECT 'orders' AS table_name, 'input' AS \"check\", CAST(NULL AS VARCHAR) AS \"column\", 'FAIL' AS status",
    "quarantine_files": ALL["quarantine_summary"],
    "report_files": f"SELECT section, section_verdict, checks FROM ({ALL['section_verdicts']})",
    "suggested_configuration": "SELECT * FROM (VALUES ('orders', 'o_orderkey', 'o_custkey,o_totalprice', 'o_orderdate'),"
    " ('customer', 'c_custkey', 'c_nationkey,c_acctbal', ''), ('lineitem', 'l_orderkey',"
    " 'l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax', 'l_shipdate'))"
    " AS found(table_name, primary_key, aggregates, datetimes)",
    "copied_targets": "SELECT 'orders[1]' AS table_name, 'volume' AS \"check\", CAST(NULL AS VARCHAR) AS \"column\", 'PASS' AS status,"
    " count(*) AS src_rows, count(*) AS tgt_rows FROM orders UNION ALL SELECT 'orders[2]', 'volume', NULL, 'FAIL', count(*),"
    " count(*) FILTER (WHERE o_orderkey % 4 <> 0) FROM orders",
    "sampled_rows": "SELECT o_orderkey, o_custkey FROM orders WHERE left(md5('0:' || o_orderkey), 8) < '19999999'",
    "agg_presence": _with(ORDERS) + "SELECT 'orders' AS table_name, 'junk_values' AS \"check\", 'o_totalprice' AS \"column\", 'FAIL' AS status,"
    " count(*) AS junk_rows FROM tgt WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'orders', 'column_presence', 'o_custkey', 'FAIL', NULL"
    " UNION ALL SELECT 'orders', 'column_presence', 'o_orderpriority', 'WARN', NULL",
    "isolated_checks": f"SELECT * FROM ({_FULL}) WHERE \"column\" IS DISTINCT FROM 'o_totalprice'",
    "tz_offset_hot_keys": _with(
        EVENTS, "hsrc AS (SELECT event_id % 5 AS k, ts FROM esrc)", "htgt AS (SELECT event_id % 5 AS k, ts FROM etgt WHERE event_id % 3 = 0)"
    ) + _offset("events", "ts", "k", "hsrc", "htgt"),
    "quarantine_positions": """SELECT o_orderkey, CAST(place AS BIGINT) AS _row_index, concat_ws('; ',
    CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus has a value that is not allowed: ' || o_orderstatus END,
    CASE WHEN nth > 1 THEN 'duplicate key in o_custkey: ' || o_custkey END) AS _validation_errors
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY place) AS nth FROM (SELECT *, row_number() OVER () - 1 AS place FROM orders))
  WHERE o_orderstatus NOT IN ('F', 'O') OR nth > 1""",
    "join_four_parts": """WITH d AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 5 <> 0
    UNION ALL SELECT o_orderkey, 'again' FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 11 = 0)
  SELECT o_orderkey, a.o_custkey, b.o_totalprice, c.o_orderstatus, d.o_orderpriority
  FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 83 <> 0) a
  FULL JOIN (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 89 <> 0) b USING (o_orderkey)
  FULL JOIN (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0) c USING (o_orderkey)
  FULL JOIN d USING (o_orderkey)""",
    "sampled_exactly": "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('0:' || o_orderkey) LIMIT 100",
    "replayed_batches": _with(ORDERS) + """SELECT 'orders' AS table_name, 'volume' AS "check",
    CASE WHEN abs(a - b) * 100.0 / a <= 0.1 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(a AS BIGINT) AS src_rows, CAST(b AS BIGINT) AS tgt_rows,
    CAST(NULL AS DOUBLE) AS src_value, CAST(NULL AS DOUBLE) AS tgt_value
  FROM (SELECT (SELECT count(*) FROM src) AS a, (SELECT count(*) FROM tgt) AS b)
  UNION ALL SELECT 'orders', 'sum', CASE WHEN a = b THEN 'PASS' WHEN abs(a - b) / abs(a) * 100 <= 1 THEN 'WARN' ELSE 'FAIL' END, NULL, NULL,
    round(CAST(a AS DOUBLE), 2), round(CAST(b AS DOUBLE), 2)
  FROM (SELECT (SELECT sum(CAST(o_totalprice AS DECIMAL(18,4))) FROM src) AS a, (SELECT sum(CAST(o_totalprice AS DECIMAL(18,4))) FROM tgt) AS b)""",
    "incremental_overlap_estimate": _with(ORDERS) + """SELECT 'identity' AS "check", CASE WHEN c * 100.0 / s >= 95 THEN 'PASS' ELSE 'WARN' END AS status,
    round(CAST(c * 100.0 / s AS DOUBLE), 4) AS exact_overlap_pct, true AS within_error
  FROM (SELECT (SELECT count(DISTINCT o_orderkey) FROM src) AS s,
    (SELECT count(*) FROM (SELECT o_orderkey FROM src INTERSECT SELECT o_orderkey FROM tgt)) AS c)""",
}
