"""Keyed behavioural features: entropy, fan-out, regularity, lexical totals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_entropy(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, entropy, total, distinct_values``: Shannon entropy in bits of a value's counts.

    Two levels: counts per key and value are added up before anything is gathered
    by key, so a hot key is spread over its values.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    c = F.col("_c").cast("double")
    grouped = counts.groupBy(*keys).agg(F.sum("_c").alias("total"), F.sum(c * F.log2(c)).alias("_s"), F.count("*").alias("distinct_values"))
    entropy = F.log2(F.col("total").cast("double")) - F.col("_s") / F.col("total")
    return grouped.select(*keys, F.greatest(entropy, F.lit(0.0)).alias("entropy"), "total", "distinct_values")


def fanout(flows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct target ports and addresses, distinct pairs of both, and attempts per key."""
    pairs = flows.groupBy(*keys, "dst_ip", "dst_port").agg(F.count("*").alias("_n"))
    return pairs.groupBy(*keys).agg(
        F.countDistinct("dst_port").alias("unique_ports"), F.countDistinct("dst_ip").alias("unique_ips"),
        F.count("*").alias("distinct_targets"), F.sum("_n").alias("attempts"),
    )


def sources_per_target(flows: DataFrame, keys: list[str]) -> DataFrame:
    counts = flows.groupBy(*keys, "src_ip").agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.count("*").alias("unique_sources"), F.sum("_n").alias("flow_count"))


def dns_source_stats(dns: DataFrame) -> DataFrame:
    """DNS events, distinct names and repeats per source."""
    counts = dns.groupBy("src_ip", "dns_query").agg(F.count("*").alias("_n"))
    grouped = counts.groupBy("src_ip").agg(F.sum("_n").alias("dns_events"), F.count("*").alias("distinct_domains"))
    return grouped.withColumn("repeats", F.col("dns_events") - F.col("distinct_domains"))


def dns_flow_stats(dns: DataFrame, keys: list[str]) -> DataFrame:
    """Per flow: events, most frequent connection state, distinct names, longest length and the longest name.

    Ties go to the smallest state and the last name in order.
    """
    per_state = dns.groupBy(*keys, "conn_state").agg(F.count("*").alias("_n"))
    modal = per_state.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), "conn_state"))["conn_state"].alias("modal_state"))
    stats = dns.groupBy(*keys).agg(
        F.count("*").alias("dns_event_count"), F.countDistinct("dns_query").alias("distinct_domains"), F.max(F.char_length("dns_query")).alias("max_length"),
        F.max_by("dns_query", F.struct(F.char_length("dns_query"), F.col("dns_query"))).alias("longest_query"),
    )
    return stats.join(modal, keys)


def inter_arrival(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Rows with ``gap``, the seconds since the previous row of the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("gap", F.col("ts") - F.lag("ts").over(w))


def numbered_gaps(rows: DataFrame, keys: list[str], stretch_s: float = 3600.0) -> DataFrame:
    """Rows with ``gap`` to the one before of their keys, null for the first, and ``place``, how many gaps come before it.

    Rows are sorted within stretches of time; of a key's whole history only one row per
    stretch meets in one task, so a busy key is spread over time.  Null is a key as any other.
    """
    timed = rows.withColumns({"_key": F.struct(*keys), "_s": F.floor(F.col("ts") / stretch_s)})
    whole = Window.partitionBy("_key").orderBy("_s")
    ends = timed.groupBy("_key", "_s").agg(F.count("*").alias("_n"), F.max("ts").alias("_last"))
    ends = ends.select("_key", "_s", F.lag("_last").over(whole).alias("_before"), F.coalesce(F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_key", "_s").orderBy("ts", "event_id")
    placed = timed.withColumns({"_lag": F.lag("ts").over(inside), "_row": F.row_number().over(inside)}).join(ends, ["_key", "_s"])
    return placed.withColumns({"gap": F.col("ts") - F.coalesce("_lag", "_before"), "place": F.col("_from") + F.col("_row") - 2}).drop("_key", "_s", "_lag", "_row", "_before", "_from")


def inter_arrival_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, flows, mean_gap, std_gap, cv``: no gaps give 0, a mean near 0 gives infinity."""
    gaps = numbered_gaps(rows, keys)
    stats = gaps.groupBy(*keys).agg(
        F.count("*").alias("flows"), F.count("gap").alias("_n"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap"),
        F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("std_gap"),
    )
    cv = F.when(F.col("_n") < 2, 0.0).when(F.col("mean_gap") < 1e-9, float("inf")).otherwise(F.col("std_gap") / F.col("mean_gap"))
    return stats.withColumn("cv", cv).drop("_n")


def acf_of(series: Column) -> Column:
    """Normalized autocorrelation of an array at lags 0 to half its length; short ones give [1], flat ones zeros."""

    @F.pandas_udf("array<double>")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(acf_values)

    return run(series)


def acf_values(x: np.ndarray) -> np.ndarray:
    """The values of ``acf_of``; the series is centred once, and long ones go by their spectrum."""
    n = len(x)
    if n < 3:
        return np.ones(1)
    most, x = n // 2 + 1, x - x.sum() / n
    square = x @ x
    if square / n < 1e-12:
        return np.zeros(most)
    if n <= 256:
        products = np.correlate(x, x, "full")[n - 1 : n - 1 + most]
    else:
        width = 1 << (2 * n - 1).bit_length()
        products = np.fft.irfft(np.abs(np.fft.rfft(x, width)) ** 2, width)[:most]
    return np.append(1.0, products[1:] / square)


def lag_products(blocks: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """``keys, lag, product``: sums of the products of a series with itself, shifted by each lag up to half its length.

    ``blocks`` has ``keys, block, n`` and ``_x``, the ``longest`` centred values of each
    block in order, the last one shorter.  Each block meets the later ones within reach;
    a task adds up what it has before it hands on, and the rest is a sum per lag.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    reach = F.least(F.floor((F.floor(F.col("n") / 2) + longest - 1) / longest), F.floor((F.col("n") - 1) / longest) - F.col("block"))
    left = blocks.withColumn("_shift", F.explode(F.sequence(F.lit(0), reach.cast("int")))).withColumn("_other", F.col("block") + F.col("_shift"))
    right = blocks.select(*keys, F.col("block").alias("_other"), F.col("_x").alias("_y"))
    pairs = left.join(right, [*keys, "_other"]).select(*keys, "_shift", "_x", "_y")
    made = pairs.select(*keys, F.lit(0).cast("long").alias("lag"), F.lit(0.0).alias("product"))
    schema = to_arrow_schema(made.schema)
    width = 1 << (2 * longest - 1).bit_length()

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}

        def rows():
            for at, total in sums.items():
                lags = at[-1] * longest + np.arange(1 - longest, longest)
                whole = lags >= 0
                columns = [pa.array([value] * int(whole.sum()), field.type) for value, field in zip(at[:-1], schema)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lags[whole]), pa.array(total[whole])], schema=schema)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:-2]]
            for k in range(batch.num_rows):
                x, y = (np.asarray(c[k].values.to_numpy(zero_copy_only=False)) for c in batch.columns[-2:])
                full = np.fft.irfft(np.fft.rfft(y, width) * np.conj(np.fft.rfft(x, width)), width)
                at = tuple(c[k] for c in columns)
                total = np.concatenate((full[width - longest + 1 :], full[:longest]))
                sums[at] = sums[at] + total if at in sums else total
                if len(sums) >= 256:
                    yield from rows()
                    sums.clear()
        yield from rows()

    return pairs.mapInArrow(run, made.schema).groupBy(*keys, "lag").agg(F.sum("product").alias("product"))


def autocorrelation(rows: DataFrame, keys: list[str], longest: int = 4096) -> DataFrame:
    """``keys, acf, acf_peak, acf_lag``: autocorrelation of each key's gaps, with its peak from lag 2 on.

    Gaps are numbered and gathered in blocks of ``longest``.  A key with one block is
    computed as an array; of a longer one the mean and norm are aggregated and the
    products of blocks and shifted blocks are added up per lag, over the whole series.
    """
    numbered = numbered_gaps(rows, keys).where("gap is not null").withColumn("block", F.floor(F.col("place") / longest))
    blocks = numbered.groupBy(*keys, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gap"))), lambda g: g["gap"]).alias("_x"))
    add = lambda a, x: a + x
    totals = blocks.groupBy(*keys).agg(F.sum(F.size("_x")).alias("n"), F.sum(F.aggregate("_x", F.lit(0.0), add)).alias("_sum"))
    # Null is a key as any other, so keys are joined as one value that is never null.
    blocks, totals = (x.withColumn("_key", F.struct(*keys)) for x in (blocks, totals))
    whole = blocks.drop(*keys).join(totals.select("_key", "n", "_sum"), "_key")
    acf = whole.where(F.col("n") <= longest).select("_key", acf_of(F.col("_x")).alias("acf"))
    late = F.slice("acf", F.lit(3), F.greatest(F.size("acf") - 2, F.lit(0)))
    peak = F.coalesce(F.array_max(late), F.lit(0.0))
    lag = F.when(F.size(late) > 0, F.array_position(late, peak) + 1).otherwise(0)
    short = acf.withColumns({"acf_peak": peak, "acf_lag": lag})

    mean = F.col("_sum") / F.col("n")
    centred = whole.where(F.col("n") > longest).withColumn("_x", F.transform("_x", lambda x: x - mean)).select("_key", "block", "n", "_x")
    named = centred.withColumn("_text", F.to_json("_key", {"ignoreNullFields": "false"}))
    squares = named.groupBy("_text").agg(F.first("_key").alias("_key"), F.first("n").alias("n"), F.sum(F.aggregate(F.transform("_x", lambda x: x * x), F.lit(0.0), add)).alias("_square"))
    products = lag_products(named.drop("_key"), ["_text"], longest).join(squares, "_text").where(F.col("lag") <= F.floor(F.col("n") / 2))
    value = F.when(F.col("_square") / F.col("n") < 1e-12, 0.0).when(F.col("lag") == 0, 1.0).otherwise(F.col("product") / F.col("_square"))
    best = F.max(F.when(F.col("lag") >= 2, F.struct("r", (-F.col("lag")).alias("l"))))
    long = products.withColumn("r", value).groupBy("_text").agg(
        F.first("_key").alias("_key"), F.transform(F.array_sort(F.collect_list(F.struct("lag", "r"))), lambda p: p["r"]).alias("acf"), best.alias("_best")
    )
    long = long.select("_key", "acf", F.col("_best.r").alias("acf_peak"), (-F.col("_best.l")).alias("acf_lag"))
    return short.unionByName(long).select(*[F.col("_key")[k].alias(k) for k in keys], "acf", "acf_peak", "acf_lag")


SPECTRUM = "_text string, n long, k long, re double, im double"


def partial_spectra(blocks: DataFrame) -> DataFrame:
    """Fourier sums of blocks of a series, turned to the phase that the block's place has in the whole.

    ``blocks`` has ``_text, n, _at`` and the centred values ``_x`` from place ``_at`` on.
    A task adds up what it has of a key before it hands on its components from 1 to n / 2.
    """
    import pyarrow as pa

    schema = pa.schema([("_text", pa.string()), ("n", pa.int64()), ("k", pa.int64()), ("re", pa.float64()), ("im", pa.float64())])

    def run(batches):
        text, n, total = None, 0, None

        def rows():
            k = np.arange(1, len(total))
            return pa.RecordBatch.from_arrays([pa.array([text] * len(k), pa.string()), pa.array(np.full(len(k), n)), pa.array(k), pa.array(total.real[1:]), pa.array(total.imag[1:])], schema=schema)

        for batch in batches:
            for own, size, at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if own != text:
                    if text is not None:
                        yield rows()
                    text, n, total = own, size, np.zeros(size // 2 + 1, complex)
                turn = np.exp(-2j * np.pi * (np.arange(size // 2 + 1) * at % size) / size)
                total += np.fft.rfft(x.values.to_numpy(), size) * turn
        if text is not None:
            yield rows()

    return blocks.select("_text", "n", "_at", "_x").sortWithinPartitions("_text").mapInArrow(run, SPECTRUM)


def dominant_frequency(rows: DataFrame, keys: list[str], longest: int = 4096) -> DataFrame:
    """``keys, frequency, magnitude`` of the strongest component but the constant one of each key's gaps.

    A component is a sum over blocks of at most ``longest`` gaps, so no task holds a
    key's gaps, only sums for its frequencies.  Of equal components the slowest counts;
    under 4 gaps both are 0.
    """
    gaps = numbered_gaps(rows, keys).where("gap is not null").withColumn("_text", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    block = F.floor(F.col("place") / longest)
    blocks = gaps.groupBy("_text", block.alias("_b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gap"))), lambda g: g["gap"]).alias("_x"))
    add = lambda a, x: a + x
    totals = blocks.groupBy("_text").agg(F.sum(F.size("_x")).alias("n"), F.sum(F.aggregate("_x", F.lit(0.0), add)).alias("_sum"))
    mean = F.col("_sum") / F.col("n")
    centred = blocks.join(totals, "_text").where("n >= 4").select("_text", "n", (F.col("_b") * longest).alias("_at"), F.transform("_x", lambda x: x - mean).alias("_x"))
    summed = partial_spectra(centred).groupBy("_text", "n", "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    power = F.struct(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("m"), (-F.col("k")).alias("k"))
    best = summed.groupBy("_text", "n").agg(F.max(power).alias("b")).select("_text", (-F.col("b.k") / F.col("n")).alias("frequency"), F.col("b.m").alias("magnitude"))
    named = gaps.groupBy("_text").agg(*[F.first(k).alias(k) for k in keys])
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("frequency", "magnitude")]
    return named.join(best, "_text", "left").select(*keys, *zero)


def lexical_totals(dns: DataFrame, keys: list[str]) -> DataFrame:
    """Digits, letters, hyphens, dots, letter pairs and triples of the names of each key."""
    from ..functions.lexical import grams

    q = F.col("dns_query")
    per_row = dns.select(*keys, *[F.regexp_count(q, F.lit(p)).alias(n) for n, p in (("digits", "[0-9]"), ("letters", "[A-Za-z]"), ("hyphens", "-"), ("dots", r"\."))], grams(q, 2).alias("g2"), grams(q, 3).alias("g3"))
    totals = per_row.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("digits", "letters", "hyphens", "dots")],
        F.sum(F.size("g2")).alias("bigrams"), F.sum(F.size("g3")).alias("trigrams"),
    )
    two = per_row.select(*keys, F.explode("g2").alias("g")).distinct().groupBy(*keys).agg(F.count("*").alias("distinct_bigrams"))
    three = per_row.select(*keys, F.explode("g3").alias("g")).distinct().groupBy(*keys).agg(F.count("*").alias("distinct_trigrams"))
    return totals.join(two, keys, "left").join(three, keys, "left").fillna(0, ["distinct_bigrams", "distinct_trigrams"])


def file_summary(rows: DataFrame, source: str) -> DataFrame:
    """Events and flows, DNS, TLS and QUIC among them, per source."""
    kind = F.col("event_type")
    return rows.groupBy(source).agg(
        F.count("*").alias("events"), F.count_if(kind == "flow").alias("flows"), F.count_if(kind == "dns").alias("dns_flows"),
        F.count_if(kind == "tls").alias("tls_flows"), F.count_if(kind == "quic").alias("quic_flows"),
    )
