"""Timestamps: values that do not parse, time-zone awareness, and systematic offsets (shape 4)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel import results as R
from evenkeel.functions import values as V
from evenkeel.functions.values import quote
from evenkeel.operators.aggregates import missing
from evenkeel.operators.facts import ScalarCheck, Side, derived
from evenkeel.operators.keys import PER_KEY, KeyReader, key_reader
from evenkeel.operators.run import scalar_rows
from evenkeel.results import FAIL, PASS, WARN, Finding, case, text
from evenkeel.session import require_utc
from evenkeel.staging import stage

# Distinct timestamps of a key that go to one task.
ROWS_PER_SPLIT = 50_000

# Up to so many distinct timestamps on one side of a key, each is paired with each of the other side: this many rows per
# timestamp at most. Keys with more on both sides are counted without building their pairs.
NARROW = 32

# Deltas tried at once in the search for the median, over coarse timestamps and over all; coarse ones of a key.
COARSE_PROBES, PROBES = 8, 3
COARSE = 4096


# --- parse failures and awareness: scalar metrics -------------------------------------------


class _Stamps:
    """What is known of the timestamps of one side. Typed columns always parse and have one zone; only
    text is parsed, and zones are compared as minutes, so the aggregate keeps numbers."""

    def __init__(self, side: Side, column: str):
        c, dtype = side.col(column), side.dtype(column)
        self.is_text, self.aware = isinstance(dtype, T.StringType), isinstance(dtype, T.TimestampType)
        if self.is_text:
            parsed = derived(V.to_timestamp(c, dtype))
            minutes = f"CASE WHEN {parsed} IS NOT NULL THEN {derived(V.offset_minutes(c))} END"
            bad = f"CASE WHEN {c} IS NOT NULL AND {parsed} IS NULL THEN {c} END"
            self.bad = side.count_where("unparsed", column, f"{c} IS NOT NULL AND {parsed} IS NULL")
            self.valid = side.count_where("parsed", column, f"{parsed} IS NOT NULL")
            self.zoned = side.count_where("zoned", column, f"{minutes} IS NOT NULL")
            self.low, self.high = side.lowest("zone_low", column, minutes), side.highest("zone_high", column, minutes)
            self.first, self.last = side.lowest("unparsed_first", column, bad), side.highest("unparsed_last", column, bad)
            self.metrics = [self.bad, self.valid, self.zoned, self.low, self.high, self.first, self.last]
        elif V.type_family(dtype) == "time":
            self.bad, self.valid = None, side.nonnull(column)
            self.metrics = [self.valid]
        else:  # a number is no timestamp
            self.bad, self.valid = side.nonnull(column), None
            self.metrics = [self.bad]

    def facts(self, get) -> dict[str, str]:
        if self.is_text:
            valid, zoned, low, high = (get(m) for m in (self.valid, self.zoned, self.low, self.high))
            zone = (
                f"CASE WHEN {zoned} = 0 THEN 'naive' WHEN {zoned} < {valid} OR {low} <> {high} THEN 'mixed'"
                f" ELSE {V.zone_name(low)} END"
            )
            return {
                "bad": get(self.bad), "valid": valid, "naive": f"({valid} - {zoned})", "zone": get.let(zone),
                "samples": f"{get(self.first)}, {get(self.last)}",
            }
        bad, valid = (get(m) if m else "0L" for m in (self.bad, self.valid))
        return {
            "bad": bad, "valid": valid, "naive": "0L" if self.aware else valid,
            "zone": quote("UTC" if self.aware else "naive"), "samples": "CAST(NULL AS STRING)",
        }


def plan_datetime(source: Side, target: Side, column: str, expected_tz: str | None = None) -> ScalarCheck:
    for side, where in ((source, "the source"), (target, "the target")):
        if column not in side:
            return missing("datetime", "datetime", column, FAIL, where)
    ms, mt = _Stamps(source, column), _Stamps(target, column)

    def decide(s, t):
        src, tgt = ms.facts(s), mt.facts(t)
        bad_s, bad_t, zone_s, zone_t = src["bad"], tgt["bad"], src["zone"], tgt["zone"]
        parses = s.let(f"{src['valid']} > 0 AND {tgt['valid']} > 0")
        broken = f"{zone_s} = 'mixed' OR {zone_t} = 'mixed' OR ({zone_s} = 'naive') <> ({zone_t} = 'naive')"
        if expected_tz:
            agrees = f"{zone_s} = {quote(expected_tz)} AND {zone_t} = {quote(expected_tz)}"
            status = case((broken, FAIL), (agrees, PASS), otherwise=WARN)
        else:
            status = case((broken, FAIL), otherwise=PASS)
        return [
            Finding(
                "datetime", "datetime_parse", column, quote(FAIL),
                text("values that are no timestamp: source %d, target %d", bad_s, bad_t),
                {"src_parse_failures": bad_s, "tgt_parse_failures": bad_t},
                samples=f"array_distinct(array_compact(array({src['samples']}, {tgt['samples']})))",
                when=f"{bad_s} > 0 OR {bad_t} > 0",
            ),
            Finding(
                "datetime", "datetime", column, quote(WARN),
                quote("a side holds no timestamp; zones are not compared"), when=f"NOT {parses}",
            ),
            Finding(
                "datetime", "tz_awareness", column, status,
                text("time zone: source %s, target %s", zone_s, zone_t),
                {"src_naive": src["naive"], "tgt_naive": tgt["naive"]},
                {"src_tz": zone_s, "tgt_tz": zone_t, "expected_tz": quote(expected_tz or "")},
                when=parses,
            ),
        ]

    return ScalarCheck(ms.metrics, mt.metrics, decide)


# --- systematic offset: rows of both sides with the same key ---------------------------------


def stamp_rows(
    df: DataFrame, key: str, columns: Sequence[str], read: KeyReader = Side.col, keep_all: bool = False
) -> DataFrame:
    """``(column, k, ts, n)`` with ``ts`` in microseconds. Rows without key or timestamp have no pair; they are
    kept for the first column if ``keep_all``, so that keys can be counted in the same pass."""
    side = Side.of(df)
    structs = ", ".join(
        f"struct({quote(c)} AS column, {read(side, key)} AS k,"
        f" unix_micros({V.to_timestamp(side.col(c), side.dtype(c))}) AS ts)"
        for c in columns
    )
    wanted = "k IS NOT NULL AND ts IS NOT NULL"
    if keep_all:
        wanted = f"column = {quote(columns[0])} OR ({wanted})"
    return df.selectExpr(f"inline(array({structs}))").where(wanted).selectExpr("*", "1L AS n")


def compact(rows: DataFrame) -> DataFrame:
    return rows.groupBy("column", "k", "ts").agg(F.sum("n").alias("n"))


WIDE = "DECIMAL(38,0)"
_PAIRS = "CAST(CAST(sn AS DECIMAL(19,0)) * CAST(tn AS DECIMAL(19,0)) AS DECIMAL(38,0))"


def _minutes(source: str, target: str) -> str:
    return f"CAST(bround(({target} - {source}) / 60e6D) AS BIGINT)"


def reduce_keys(source_rows: DataFrame, target_rows: DataFrame) -> DataFrame:
    """``(column, delta, several_k, pairs, <key counts>)``, staged; small unless timestamps of keys vary.

    A key repeated on both sides pairs every row with every row, so a plain join of a hot key grows
    with the square of its rows. Here one aggregate per key keeps counts and the first and last
    timestamp of each side. Where each side shows a single timestamp, which covers unique keys and
    repeated equal rows, the pairs are ``sn * tn`` with one delta. Only keys with several distinct
    timestamps stay as rows of their own.
    """
    s = source_rows.selectExpr(
        "column", "k", "n AS src_n", "0L AS tgt_n", "IF(ts IS NULL, 0L, n) AS sn", "0L AS tn", "ts AS s",
        "CAST(NULL AS BIGINT) AS t",
    )
    t = target_rows.selectExpr(
        "column", "k", "0L AS src_n", "n AS tgt_n", "0L AS sn", "IF(ts IS NULL, 0L, n) AS tn",
        "CAST(NULL AS BIGINT) AS s", "ts AS t",
    )
    keys = s.unionByName(t).groupBy("column", "k").agg(
        *[F.expr(f"sum({c})").alias(c) for c in ("src_n", "tgt_n", "sn", "tn")],
        *[F.expr(sql).alias(c) for c, sql in {"s0": "min(s)", "s1": "max(s)", "t0": "min(t)", "t1": "max(t)"}.items()],
    )
    keys = keys.selectExpr("*", "k IS NOT NULL AND sn > 0 AND tn > 0 AS paired", "s0 = s1 AND t0 = t1 AS single")
    reduced = keys.selectExpr(
        "column",
        f"CASE WHEN paired AND single THEN {_minutes('s0', 't0')} END AS delta",
        "CASE WHEN paired AND NOT single THEN k END AS several_k",
        f"CASE WHEN paired THEN {_PAIRS} END AS pairs",
        *[f"{sql} AS {name}" for name, sql in PER_KEY.items()],
    )
    return stage(
        reduced.groupBy("column", "delta", "several_k").agg(
            F.expr("CAST(sum(pairs) AS DECIMAL(38,0))").alias("pairs"),
            *[F.expr(f"sum({name})").alias(name) for name in PER_KEY],
        ),
        "deltas",
    )


def key_facts(reduced: DataFrame, column: str) -> DataFrame:
    """The result of :func:`evenkeel.operators.keys.facts`, where rows of ``column`` were all kept."""
    return reduced.where(f"column = {quote(column)}").selectExpr(
        *[f"coalesce(sum({name}), 0L) AS {name}" for name in PER_KEY]
    )


@dataclass(frozen=True)
class Deltas:
    """Differences of all row pairs with one key.

    ``histogram``: ``(column, delta, pairs)``, how many pairs lie ``delta`` minutes apart, staged if it has to be computed
    from more than the reduced keys. ``wide``: ``(column, k, ts, sn, tn)``, the distinct timestamps of further keys with
    their rows on either side, staged; their pairs are only ever counted.
    """

    histogram: DataFrame
    wide: DataFrame | None = None


def key_deltas(reduced: DataFrame, source_rows: DataFrame, target_rows: DataFrame) -> Deltas:
    """The differences for :func:`reduce_keys` of the same rows.

    Keys with several timestamps are reduced to counts per distinct timestamp, made before anything is shuffled by the
    key alone. A key with few of them on one side is joined: the other side is dealt out to parts, as many as its
    timestamps call for (``splits``, negative where that is the target), and the few are copied to each. Spark broadcasts
    the list of keys if it finds it small.
    """
    histogram = reduced.where("delta IS NOT NULL").select("column", "delta", "pairs")
    several = reduced.where("several_k IS NOT NULL").selectExpr("column", "several_k AS k")
    if several.isEmpty():
        return Deltas(histogram)
    on = ["column", "k"]
    both = source_rows.selectExpr("column", "k", "ts", "n AS sn", "0L AS tn").unionByName(
        target_rows.selectExpr("column", "k", "ts", "0L AS sn", "n AS tn")
    )
    both = both.where("ts IS NOT NULL").groupBy("column", "k", "ts").agg(F.sum("sn").alias("sn"), F.sum("tn").alias("tn"))
    stamps = stage(both.join(several, on), "stamps-of-keys")
    shapes = stamps.groupBy(on).agg(F.count_if(F.col("sn") > 0).alias("s"), F.count_if(F.col("tn") > 0).alias("t"))
    shapes = shapes.selectExpr(
        "column", "k", f"least(s, t) > {NARROW} AS wide",
        f"CAST(ceil(greatest(s, t) / {ROWS_PER_SPLIT}) AS INT) * IF(s >= t, 1, -1) AS splits",
    )
    shapes = stage(shapes, "shapes-of-keys")
    dealt = "array(CAST(pmod(xxhash64(ts), abs(splits)) AS INT))"
    copied = "sequence(0, abs(splits) - 1)"
    narrow = stamps.join(shapes.where("NOT wide"), on)
    src = narrow.where("sn > 0").selectExpr("column", "k", f"explode(IF(splits > 0, {dealt}, {copied})) AS part", "ts AS s", "sn")
    tgt = narrow.where("tn > 0").selectExpr("column", "k", f"explode(IF(splits < 0, {dealt}, {copied})) AS part", "ts AS t", "tn")
    joined = src.join(tgt, ["column", "k", "part"]).selectExpr(
        "column", f"{_minutes('s', 't')} AS delta", f"{_PAIRS} AS pairs"
    )
    histogram = histogram.unionByName(joined).groupBy("column", "delta").agg(
        F.expr(f"CAST(sum(pairs) AS {WIDE})").alias("pairs")
    )
    wide = shapes.where("wide")
    if wide.isEmpty():
        return Deltas(stage(histogram, "delta-histogram"))
    return Deltas(stage(histogram, "delta-histogram"), stage(stamps.join(wide.select(on), on), "wide-keys"))


# --- keys with many timestamps on both sides: pairs are counted, never built ------------------

_MICROS, _HALF = 60_000_000, 30_000_000


def _sums(**sums: str) -> list:
    return [F.expr(f"CAST(sum({sql}) AS {WIDE})").alias(name) for name, sql in sums.items()]


def _times(a: str, b: str) -> str:
    return f"CAST({a} AS {WIDE}) * CAST({b} AS {WIDE})"


def wide_moments(wide: DataFrame) -> DataFrame:
    """``(column, rows, total, squares, low, high)``: pairs, sum and sum of squares of their whole minutes, and bounds.

    A timestamp is a minute m and a rest below it. The rounded difference of a pair is the difference of its minutes,
    moved by one where the rests are more than half a minute apart (or just that, with an odd difference). Sums over
    differences of minutes follow from sums per key. Moved pairs are those whose rest in the source lies below, or
    above, the target's rest half a minute on: running sums over the rests of a key count them. A rest is one of
    60 million values, and running sums are taken within a second and over the 60 seconds, so no group grows beyond that.
    """
    rows = wide.selectExpr(
        "column", "k", "ts", "sn", "tn", f"pmod(ts, {_MICROS}L) AS rest", f"(ts - pmod(ts, {_MICROS}L)) div {_MICROS}L AS m0"
    )
    base = wide.groupBy("column").agg(F.min("ts").alias("first"))
    rows = rows.join(F.broadcast(base), "column")  # one row for each configured column
    rows = rows.withColumn("m", F.expr(f"m0 - (first - pmod(first, {_MICROS}L)) div {_MICROS}L"))

    per_key = rows.groupBy("column", "k").agg(
        *_sums(sn="sn", sa=_times("sn", "m"), saa=_times(_times("sn", "m"), "m")),
        *_sums(tn="tn", tb=_times("tn", "m"), tbb=_times(_times("tn", "m"), "m")),
        *[F.expr(f"{f}(IF({n} > 0, ts, NULL))").alias(f + n) for f in ("min", "max") for n in ("sn", "tn")],
    )
    whole = per_key.groupBy("column").agg(
        *_sums(
            rows=_times("sn", "tn"),
            minutes=f"{_times('sn', 'tb')} - {_times('tn', 'sa')}",
            squares=f"{_times('sn', 'tbb')} - 2 * {_times('tb', 'sa')} + {_times('tn', 'saa')}",
        ),
        F.expr(f"min({_minutes('maxsn', 'mintn')})").alias("low"),
        F.expr(f"max({_minutes('minsn', 'maxtn')})").alias("high"),
    )

    odd = "pmod(m, 2)"
    source = rows.where("sn > 0").selectExpr("column", "k", "rest AS place", "m", "sn", "0L AS tn")
    target = rows.where("tn > 0").selectExpr("column", "k", f"(rest + {_HALF}L) % {_MICROS}L AS place", "m", "0L AS sn", "tn")
    places = source.unionByName(target).groupBy("column", "k", "place").agg(
        *_sums(sn="sn", sa=_times("sn", "m"), sno=f"sn * {odd}", sao=_times(f"sn * {odd}", "m")),
        *_sums(tn="tn", tb=_times("tn", "m"), tno=f"tn * {odd}", tbo=_times(f"tn * {odd}", "m")),
    )
    places = places.withColumn("second", F.expr("place div 1000000L"))
    below = Window.partitionBy("column", "k", "second").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast(WIDE)
    for name, sums in (("bn", "sn"), ("ba", "sa")):
        places = places.withColumn(name, F.coalesce(F.sum(sums).over(below).cast(WIDE), nothing))
    seconds = places.groupBy("column", "k", "second").agg(
        *_sums(
            sn="sn", sa="sa", tn="tn", tb="tb",
            x1=_times("tn", "bn"), x2=f"{_times('tb', 'bn')} - {_times('tn', 'ba')}",
            e1=_times("tn", "sn"), e2=f"{_times('tb', 'sn')} - {_times('tn', 'sa')}",
            o1=f"{_times('tno', '(sn - sno)')} + {_times('(tn - tno)', 'sno')}",
            o2=f"{_times('tbo', '(sn - sno)')} - {_times('tno', '(sa - sao)')} + {_times('(tb - tbo)', 'sno')} - {_times('(tn - tno)', 'sao')}",
        )
    )
    earlier = Window.partitionBy("column", "k").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    key = Window.partitionBy("column", "k")
    for name, sums in (("bn", "sn"), ("ba", "sa")):
        seconds = seconds.withColumn(name, F.coalesce(F.sum(sums).over(earlier).cast(WIDE), nothing))
        seconds = seconds.withColumn("all_" + name, F.sum(sums).over(key).cast(WIDE))
    upto = f"x1 + {_times('tn', 'bn')}", f"x2 + {_times('tb', 'bn')} - {_times('tn', 'ba')}"
    all_of = _times("tn", "all_bn"), f"{_times('tb', 'all_bn')} - {_times('tn', 'all_ba')}"
    # the target's rest is half a minute or more in the first 30 seconds of the places
    moved = seconds.selectExpr(
        "column", "IF(second < 30, 1, -1) AS by",
        f"CAST(IF(second < 30, {upto[0]} + o1, {all_of[0]} - ({upto[0]}) - e1 + o1) AS {WIDE}) AS n",
        f"CAST(IF(second < 30, {upto[1]} + o2, {all_of[1]} - ({upto[1]}) - e2 + o2) AS {WIDE}) AS d",
    )
    moved = moved.groupBy("column").agg(*_sums(total="by * n", squares="2 * by * d + n"))
    moved = moved.withColumnsRenamed({"total": "more", "squares": "more_squares"})
    return whole.join(F.broadcast(moved), "column").selectExpr(
        "column", "rows", f"CAST(minutes + more AS {WIDE}) AS total", f"CAST(squares + more_squares AS {WIDE}) AS squares", "low", "high"
    )


def pairs_upto(wide: DataFrame, probes: DataFrame) -> DataFrame:
    """``(column, probe, pairs)``: how many pairs lie ``probe`` minutes apart at most, for a few ``(column, probe)``.

    A pair counts if its source timestamp is not below the target's less the largest difference that rounds to the
    probe. Both are sorted together, in ranges, so that the timestamps of one key can be spread over many tasks; running
    sums within a range and sums of the ranges before give the counts. One row per timestamp and probe is moved.
    """
    # half a minute rounds to the even one
    reach = f"probe * {_MICROS}L + {_HALF}L - pmod(probe, 2)"
    source = wide.where("sn > 0").selectExpr("column", "k", "-ts AS place", "0 AS side", "CAST(NULL AS BIGINT) AS probe", "sn", "0L AS tn")
    target = wide.where("tn > 0").join(F.broadcast(probes), "column")
    target = target.selectExpr("column", "k", f"{reach} - ts AS place", "1 AS side", "probe", "0L AS sn", "tn")
    both = source.unionByName(target).repartitionByRange("column", "k", "place", "side")
    both = stage(both.withColumn("range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("column", "k", "range").orderBy("place", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("seen", F.sum("sn").over(within).cast(WIDE))
    parts = both.groupBy("column", "k", "range", "probe").agg(*_sums(sn="sn", tn="tn", pairs=_times("tn", "seen")))
    before = Window.partitionBy("column", "k").orderBy("range").rangeBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("sn").over(before).cast(WIDE), F.lit(0).cast(WIDE)))
    parts = parts.where("probe IS NOT NULL")
    return parts.groupBy("column", "probe").agg(*_sums(pairs=f"pairs + {_times('tn', 'before')}"))


def coarse(wide: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Two tables like ``wide`` with one row per ``width`` microseconds of a key and side, staged. Of the first, as many pairs or fewer
    lie up to any difference as of ``wide``, of the second as many or more."""
    cells = wide.groupBy("column", "k", F.expr(f"(ts - pmod(ts, {width}L))").alias("ts")).agg(F.sum("sn").alias("sn"), F.sum("tn").alias("tn"))
    cells = stage(cells, "coarse-keys")
    source = cells.where("sn > 0").selectExpr("column", "k", "ts", "sn", "0L AS tn")

    def moved(by: int) -> DataFrame:
        return source.unionByName(cells.where("tn > 0").selectExpr("column", "k", f"ts + {by}L AS ts", "0L AS sn", "tn"))

    return moved(width - 1), moved(1 - width)


def wide_medians(deltas: Deltas, moments: DataFrame) -> DataFrame:
    """``(column, median)`` of columns with wide keys, exact.

    No median is further from the mean than the deviation. From there the range of the middle pairs is narrowed by
    counting the pairs up to a few differences in a job, until one is left: first over coarse timestamps, which give bounds
    of the counts and are at most ``COARSE`` rows per key, then over all timestamps. The driver holds a few numbers per column.
    """
    spark = deltas.histogram.sparkSession
    known = deltas.wide.select("column").distinct()
    state = {}
    for r in moments.join(F.broadcast(known), "column").collect():
        n, mean = int(r["rows"]), int(r["total"]) / int(r["rows"])
        spread = (max(0, int(r["squares"]) * n - int(r["total"]) ** 2)) ** 0.5 / n + 1
        low, high = max(r["low"], math.floor(mean - spread)), min(r["high"], math.ceil(mean + spread))
        state[r["column"]] = {rank: [low, high] for rank in {(n - 1) // 2, n // 2}}

    def narrow(fewest: DataFrame, most: DataFrame, at_once: int) -> bool:
        """Try some differences of each range; whether a range became smaller."""
        tried = set()
        for column, ranges in state.items():
            for low, high in ranges.values():
                step = max(1, -(-(high - low) // (at_once + 1)))
                tried.update((column, probe) for probe in range(low + step - 1, high, step))
        probes = spark.createDataFrame(sorted(tried), "column string, probe bigint").coalesce(1)
        known = deltas.histogram.join(F.broadcast(probes), "column").where("delta <= probe").groupBy("column", "probe").agg(*_sums(pairs="pairs"))
        parts = [known.withColumn("bound", F.lit(0)), pairs_upto(fewest, probes).withColumn("bound", F.lit(1))]
        if most is not fewest:
            parts.append(pairs_upto(most, probes).withColumn("bound", F.lit(2)))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        counts = {(r["column"], r["probe"], r["bound"]): int(r["pairs"]) for r in found.collect()}
        smaller = False
        for column, probe in tried:
            below = counts.get((column, probe, 0), 0)
            least = below + counts.get((column, probe, 1), 0)
            upto = least if most is fewest else below + counts.get((column, probe, 2), 0)
            for rank, bounds in state[column].items():
                if least > rank and probe < bounds[1]:
                    bounds[1], smaller = probe, True
                elif upto <= rank and probe + 1 > bounds[0]:
                    bounds[0], smaller = probe + 1, True
        return smaller

    def widest() -> int:
        return max((high - low for ranges in state.values() for low, high in ranges.values()), default=0)

    first, last = deltas.wide.agg(F.min("ts"), F.max("ts")).first()
    width = max(1, (last - first) // COARSE)
    bounds = coarse(deltas.wide, width) if widest() > 4 * width // _MICROS + COARSE_PROBES else None
    while bounds and widest() > 4 * width // _MICROS + COARSE_PROBES and narrow(*bounds, COARSE_PROBES):
        pass
    while widest():
        narrow(deltas.wide, deltas.wide, PROBES)
    rows = [(column, sum(low for low, _ in ranges.values()) / len(ranges)) for column, ranges in state.items()]
    return spark.createDataFrame(rows, "column string, median double")


def medians(histogram: DataFrame) -> DataFrame:
    """``(column, median)``, exact for any counts.

    Pairs are summed per day of difference; running sums over the days find the one or two days that hold the middle,
    and running sums over the minutes of these days the middle itself.
    """
    upto = Window.partitionBy("column").orderBy("day")
    total = F.sum("pairs").over(Window.partitionBy("column"))
    wide = WIDE
    days = histogram.withColumn("day", F.expr("CAST(floor(delta / 1440) AS BIGINT)")).groupBy("column", "day")
    days = days.agg(F.expr(f"CAST(sum(pairs) AS {wide})").alias("pairs"))
    days = days.select("column", "day", "pairs", F.sum("pairs").over(upto).cast(wide).alias("upto"), total.cast(wide).alias("total"))
    # places of the middle, from 0
    days = days.selectExpr(
        "column", "day", "upto", "upto - pairs AS before", f"CAST(floor((total - 1) / 2) AS {wide}) AS low",
        f"CAST(floor(total / 2) AS {wide}) AS high",
    )
    days = days.where("upto > low AND before <= high").select("column", "day", "before", "low", "high")
    # one or two rows for each configured column
    minutes = histogram.withColumn("day", F.expr("CAST(floor(delta / 1440) AS BIGINT)")).join(F.broadcast(days), ["column", "day"])
    running = F.sum("pairs").over(Window.partitionBy("column", "day").orderBy("delta"))
    minutes = minutes.withColumn("upto", (F.col("before") + running).cast(wide))
    here = "upto > {0} AND upto - pairs <= {0}"
    return minutes.groupBy("column").agg(
        F.expr(
            f"(max(CASE WHEN {here.format('low')} THEN delta END) + max(CASE WHEN {here.format('high')} THEN delta END)) / 2D"
        ).alias("median")
    )


def moments_of(deltas: Deltas) -> DataFrame:
    """``(column, rows, total, squares, low, high)``: sums over whole minutes, hence exact and free of order."""
    d = "CAST(delta AS DECIMAL(12,0))"
    found = deltas.histogram.groupBy("column").agg(
        *_sums(rows="pairs", total=f"CAST(pairs * {d} AS {WIDE})", squares=f"CAST(CAST(pairs * {d} AS {WIDE}) * {d} AS {WIDE})"),
        F.min("delta").alias("low"), F.max("delta").alias("high"),
    )
    if deltas.wide is None:
        return found
    found = found.unionByName(wide_moments(deltas.wide)).groupBy("column").agg(
        *_sums(rows="rows", total="total", squares="squares"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    return stage(found, "delta-moments")


def offset_facts(deltas: Deltas, columns: Sequence[str]) -> DataFrame:
    """One row with a struct per column: pairs, median and sample deviation of the deltas."""
    moments = moments_of(deltas)
    middle = medians(deltas.histogram)
    if deltas.wide is not None:
        exact = wide_medians(deltas, moments)
        middle = middle.join(F.broadcast(exact.select("column")), "column", "left_anti").unionByName(exact)
    # a row for each configured column
    rows = moments.join(F.broadcast(middle), "column").selectExpr(
        "column", "CAST(rows AS DOUBLE) AS rows", "median", "CAST(total AS DOUBLE) AS total", "CAST(squares AS DOUBLE) AS squares"
    )
    rows = rows.selectExpr(
        "column", "rows", "median", "sqrt(try_divide(greatest(squares - total * total / rows, 0D), rows - 1)) AS std"
    )
    return rows.selectExpr(
        *[
            f"first(CASE WHEN column = {quote(c)} THEN struct(rows, median, std) END, true) AS d{i}"
            for i, c in enumerate(columns)
        ]
    )


def offset_findings(columns: Sequence[str]) -> list[Finding]:
    out = []
    offsets = ", ".join(map(str, V.ZONE_OFFSETS_MINUTES))
    for i, column in enumerate(columns):
        rows, median, std = (f"d{i}.{f}" for f in ("rows", "median", "std"))
        systematic = f"coalesce(abs({median}) IN ({offsets}) AND {std} < 5, false)"
        message = (
            f"concat(CASE WHEN {systematic} THEN 'systematic time-zone offset: ' ELSE '' END,"
            f" {text('median difference %+.1f minutes over %.0f pairs', median, rows)})"
        )
        metrics = {
            "rows_analysed": rows, "median_delta_minutes": median,
            "median_delta_hours": f"{median} / 60", "std_delta_minutes": std,
        }
        status = case((systematic, FAIL), (f"abs({median}) > 0", WARN), otherwise=PASS)
        out.append(Finding("datetime", "tz_offset", column, status, message, metrics, when=f"{rows} > 0"))
    return out


def offset_rows(
    source_rows: DataFrame, target_rows: DataFrame, columns: Sequence[str], table: str, run_id: str = ""
) -> DataFrame:
    reduced = reduce_keys(source_rows, target_rows)
    return delta_rows(key_deltas(reduced, source_rows, target_rows), columns, table, run_id)


def delta_rows(deltas: Deltas, columns: Sequence[str], table: str, run_id: str = "") -> DataFrame:
    return R.rows(offset_facts(deltas, columns), offset_findings(columns), table, run_id)


def check_tz_offset(source: DataFrame, target: DataFrame, columns: Sequence[str], key: str, table: str) -> DataFrame:
    """Median difference in minutes between rows with the same key."""
    require_utc(source.sparkSession)
    read, _ = key_reader(source.schema[key].dataType, target.schema[key].dataType)
    return offset_rows(
        stamp_rows(source, key, columns, read), stamp_rows(target, key, columns, read), columns, table
    )


def check_timezone_consistency(
    source: DataFrame,
    target: DataFrame,
    column: str,
    table: str,
    expected_tz: str | None = None,
    pk_column: str | None = None,
) -> DataFrame:
    """Parse failures, zone awareness and, with a key, the systematic offset between paired rows."""
    spark = source.sparkSession
    require_utc(spark)
    parts = [scalar_rows(source, target, [plan_datetime(Side.of(source), Side.of(target), column, expected_tz)], table)]
    needed = [column, pk_column] if pk_column else []
    if needed and all(c in df.columns for c in needed for df in (source, target)):
        parts.append(check_tz_offset(source, target, [column], pk_column, table))
    return R.union(spark, parts)
