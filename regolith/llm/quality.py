"""Quality rules for single documents, and verdicts on whole hosts from the rates at which their documents fail."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import BLANK, byte_table, mix, row_of, text_chunks, word_hashes
from ._scratch import kinds, set_apart, written

LINE = byte_table(b"\n")
SYMBOL = ~byte_table(b"#*$%&|<>")
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class HostRule:
    """A host is rejected if its shrunk failure rate lies above the prior's `quantile` and above `least`: an outlier among hosts, most of whose documents fail.
    prior_weight bounds the prior's weight in documents from below and above."""

    quantile: float = 0.95
    least: float = 0.5
    prior_weight: tuple[float, float] = (2.0, 200.0)


#: Steps into which the prior's range is cut for its quantile.
GRID = 1000


def _repeats(row: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """Words of each row in windows of three words that the row has twice or more."""
    n = len(h) - 2
    if n <= 0:
        return np.zeros(n_rows, np.int64)
    at = np.flatnonzero(row[:n] == row[2:])
    key = mix(mix(mix(h[at]) + h[at + 1]) + h[at + 2]) ^ mix(row[at].astype(np.uint64) + np.uint64(1))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[back] > 1]
    hit = np.zeros(len(h), bool)
    for k in range(3):
        hit[twice + k] = True
    return np.bincount(row[hit], minlength=n_rows)


def _duplicate_lines(words, lines, n_rows: int) -> np.ndarray:
    real = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    row = row_of(lines.word_at)[real]
    key = word_hashes(lines)[real] ^ mix(row.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(key, return_index=True)
    return np.bincount(row, minlength=n_rows) - np.bincount(row[first], minlength=n_rows)


def _measure(names: list[str], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in METRICS]
            text = batch.column(0)
            for w, lines in zip(text_chunks(text, BLANK), text_chunks(text, LINE)):
                n = w.last - w.first
                row = row_of(w.word_at)
                letters = BLANK[w.data] & ((w.data & 0xC0) != 0x80)
                upto = np.concatenate([[0], np.cumsum(letters)])
                symbols = np.flatnonzero(SYMBOL[w.data])
                found = (np.diff(w.word_at), upto[w.byte_at[1:]] - upto[w.byte_at[:-1]], np.diff(np.searchsorted(symbols, w.byte_at)), _duplicate_lines(w, lines, n), _repeats(row, word_hashes(w), n))
                for into, x in zip(out, found):
                    into.append(x)
            measured = [pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in out]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1 - with_text, batch.num_columns)), *measured], names=names)

    return run


def measured(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs, or its columns in keep, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, counted over whole texts; columns
    that have one of these names, in any case, are replaced. A null text has no words, so it fails as too short."""
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (*METRICS, "base_failed")]
    own = [c for c in names if c.lower() != text_col.lower()]
    packed, _ = set_apart(docs, (text_col, *own), docs.columns)
    with_text = len(own) < len(names)
    held = packed.columns[1 - with_text :]
    out = packed.mapInArrow(_measure([*held, *METRICS], with_text), ", ".join([*kinds(packed, held), *(f"{m} bigint" for m in METRICS)]))
    out = out.select(*("in0" if c.lower() == text_col.lower() else f"in{own.index(c) + 1}" for c in names), *METRICS)
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")).toDF(*names, *METRICS, "base_failed")


def any_failed() -> Column:
    """The rules whose failures count against a host: the base rules, symbols in over a tenth of the words, repeated lines, odd word lengths."""
    return F.expr("base_failed or 10 * n_symbols > n_words or 10 * n_dup_lines > n_words or word_chars < 2 * n_words or word_chars > 15 * n_words")


def prior_of(hosts: int, docs: int, failed: int, squares: float, crossed: float, rule: HostRule) -> tuple[float, float, float]:
    """Mean and weight of the beta prior, and the limit for shrunk rates. squares: sum over hosts of failed**2 / docs; crossed: of docs**2.

    Moments of a beta-binomial: of the hosts' squared distances from the common rate, weighted by their documents, what chance alone would give is
    taken off; the rest is the spread between hosts. Without any, the weight is its upper bound.
    """
    if not docs:
        return 0.0, rule.prior_weight[1], 1.0
    mean = failed / docs
    alone = mean * (1 - mean)
    between = squares - failed * mean - alone * (hosts - 1)
    room = alone * (docs - crossed / docs - (hosts - 1))
    spread = between / room if room > 0 else 0.0
    low, high = rule.prior_weight
    weight = min(max(1 / spread - 1, low), high) if spread > 0 else high
    at = (np.arange(GRID) + 0.5) / GRID
    density = np.exp((mean * weight - 1) * np.log(at) + ((1 - mean) * weight - 1) * np.log1p(-at))
    upto = np.cumsum(density) / density.sum()
    return mean, weight, max(rule.least, float(np.searchsorted(upto, rule.quantile) + 1) / GRID)


def host_verdicts(measures: DataFrame, host_col: str, rule: HostRule) -> DataFrame:
    """(host, host_docs, host_failed, host_rejected), one row per host; null hosts are one host.

    A host's rate is shrunk towards the rate of all documents by a beta prior that is fitted to the hosts: hosts of few documents are judged mostly by the
    others. Only five sums over hosts reach the driver.
    """
    hosts = written(measures.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("host_docs"), F.count_if(any_failed()).alias("host_failed")))
    n, f = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    s = hosts.agg(F.count("*").alias("h"), F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.sum(f * f / n).alias("s"), F.sum(n * n).alias("x")).first()
    mean, weight, limit = prior_of(s["h"], s["n"] or 0, s["f"] or 0, s["s"] or 0.0, s["x"] or 0.0, rule)
    shrunk = (F.col("host_failed") + F.lit(mean * weight)) / (F.col("host_docs") + F.lit(weight))
    return hosts.withColumn("host_rejected", shrunk > limit)


def judged(docs: DataFrame, rule: HostRule = HostRule(), text_col: str = "text", host_col: str = "source", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs, or its columns in keep, with the columns of measured(), host_docs, host_failed, host_rejected, and kept: neither failed itself nor of a rejected
    host; columns that have one of these names, in any case, are replaced.

    Texts are read once: the measured rows are written, hosts' counts are combined before their shuffle, and verdicts are joined back, in a join that the
    planner can split where a third of all rows has one host. An empty table gives an empty result; repeated rows are judged, and counted, each for itself.
    """
    extra = ("host_docs", "host_failed", "host_rejected", "kept")
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (*METRICS, "base_failed", *extra)]
    own = [c for c in names if c.lower() != text_col.lower()]
    apart, _ = set_apart(docs, (text_col, host_col, *own), docs.columns)
    held = ["in0" if c.lower() == text_col.lower() else f"in{own.index(c) + 2}" for c in names]
    rows = written(measured(apart, "in0", tuple(dict.fromkeys(["in1", *held]))))
    hosts = host_verdicts(rows, "in1", rule)
    out = rows.join(hosts, rows["in1"].eqNullSafe(hosts["host"]), "left").withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))
    return out.select(*held, *METRICS, "base_failed", *extra).toDF(*names, *METRICS, "base_failed", *extra)
