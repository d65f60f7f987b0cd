"""Quality rules whose thresholds adapt to each language and source.

One pass measures every text. Mergeable quantile sketches (counts in cells of equal ratio) per language and source give each group's usual range;
small groups borrow their language's merged sketch, and small languages the whole table's. A join brings the limits back to the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .common import carry, restore, stored, text_bytes

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words", "n_shouts", "n_stutters")
#: Measure -> numerator, denominator, slack added to the group's range, and whether values below the range count as well.
MEASURES = {"symbol_share": ("n_symbols", "n_words", 0.10, False), "dup_line_share": ("n_dup_lines", "n_lines", 0.50, False),
            "repeat_share": ("n_repeat_words", "n_words", 0.20, False), "stutter_share": ("n_stutters", "n_words", 0.15, False),
            "capital_share": ("n_capital_words", "n_words", 0.20, False),
            "shout_share": ("n_shouts", "n_words", 0.20, False), "mean_word": ("word_chars", "n_words", 1.50, True)}
QUANTILES = (0.1, 0.5)
ZERO_CELL = -(1 << 30)


def repeated_words(ids: np.ndarray, window: int) -> int:
    """Words inside windows of ``window`` words (a power of two) that occur twice or more in ``ids``; exact, by doubling of ranks."""
    n = len(ids)
    if n <= window:
        return 0
    rank, step = ids.astype(np.int64), 1
    while step < window:
        pairs = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        found, rank = np.unique(pairs, return_inverse=True)
        if step * 2 < window and len(found) == len(pairs):
            return 0  # already shorter windows never repeat
        step *= 2
    often = np.bincount(rank)[rank] > 1
    if not often.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(often), 1)
    np.add.at(edge, np.flatnonzero(often) + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The COUNTS of one text."""
    words = text.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
    order: dict[bytes, int] = {}
    ids = np.fromiter((order.setdefault(w, len(order)) for w in words), np.int64, len(words))
    chars = len(text.decode()) - sum(map(text.count, (SPACES[i:i + 1] for i in range(len(SPACES)))))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    capital = np.fromiter((len(w) > 3 and w.decode().isupper() for w in order), bool, len(order))
    return (len(words), chars, sum(text.count(SYMBOLS[i:i + 1]) for i in range(len(SYMBOLS))), len(lines) - len(set(lines)),
            repeated_words(ids, 8), len(lines), int(capital[ids].sum()) if words else 0, text.count(b"!"),
            int((ids[1:] == ids[:-1]).sum()))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of COUNTS; columns of those names are replaced. A null text counts as an empty one."""
    kept = docs.drop(*COUNTS)
    schema = StructType([*kept.schema.fields, *(StructField(c, LongType()) for c in COUNTS)])
    arrow = to_arrow_schema(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts = list(zip(*map(measure, text_bytes(part.column("text"))), strict=True)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, pa.int64()) for c in counts)], schema=arrow)

    return kept.mapInArrow(run, schema)


def _share(top: str, base: str) -> Column:
    return F.when(F.col(base) > 0, F.col(top) / F.col(base)).otherwise(0.0)


def sketched(rows: DataFrame, accuracy: float) -> DataFrame:
    """(lang, source, measure, cell, n): a quantile sketch of every measure in every group, as counts of values in cells of equal ratio.

    Sketches merge by adding counts, in any order and always to the same result. A quantile read from one is off by half of ``accuracy``
    of itself at most. Cells of values between 10^-9 and 10^9 are about ``41 / accuracy`` in number, however many rows there are.
    """
    cell = lambda x: F.when(x <= 0, ZERO_CELL).otherwise(F.ceil(F.ln(x) / math.log1p(accuracy))).cast("int")
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), cell(F.col(m)).alias("cell")) for m in MEASURES)))
    return rows.select("lang", "source", cells.alias("c")).groupBy("lang", "source", "c.measure", "c.cell").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, accuracy: float, *keys: str) -> DataFrame:
    """(keys, measure, rows, q0, q1): the QUANTILES of the sketches merged over all that ``keys`` leave out."""
    by = Window.partitionBy(*keys, "measure")  # the cells of one sketch
    merged = sketch.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    placed = merged.withColumn("run", F.sum("n").over(by.orderBy("cell"))).withColumn("rows", F.sum("n").over(by))
    value = lambda cell: F.when(cell == ZERO_CELL, 0.0).otherwise(F.pow(F.lit(1.0 + accuracy), cell - 0.5))
    at = [value(F.min(F.when(F.col("run") >= F.ceil(q * F.col("rows")), F.col("cell")))).alias(f"q{i}") for i, q in enumerate(QUANTILES)]
    return placed.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), *at)


def group_limits(rows: DataFrame, min_rows: int, width: float, accuracy: float) -> DataFrame:
    """Per language and source the highest (and lowest) usual value of each measure.

    The range reaches from the median by ``width`` times the distance between the median and the first decile, so that up to
    half of a source may be bad without moving it, plus the measure's slack. A group of fewer than ``min_rows`` rows takes its language's
    sketch, and a language of fewer the whole table's.
    """
    sketch = stored(sketched(rows, accuracy), "quality_sketches")
    own, up, top = (quantiles(sketch, accuracy, *keys) for keys in (("lang", "source"), ("lang",), ()))
    names = ("rows", "q0", "q1")
    up = up.select(F.col("lang").alias("up_lang"), F.col("measure").alias("up_measure"), *(F.col(c).alias(f"up_{c}") for c in names))
    top = top.select(F.col("measure").alias("top_measure"), *(F.col(c).alias(f"top_{c}") for c in names))
    best = (own.join(up, F.col("lang").eqNullSafe(F.col("up_lang")) & (F.col("measure") == F.col("up_measure")))
            .join(top, F.col("measure") == F.col("top_measure")))
    low, mid = (F.when(F.col("rows") >= min_rows, F.col(q)).when(F.col("up_rows") >= min_rows, F.col(f"up_{q}")).otherwise(F.col(f"top_{q}")) for q in ("q0", "q1"))
    of = lambda m, value: F.max(F.when(F.col("measure") == m, value))  # noqa: E731  one row a measure
    reach = width * (F.col("mid") - F.col("low"))
    limits = []
    for m, (_, _, slack, both) in MEASURES.items():
        limits.append(of(m, F.col("mid") + reach + slack).alias(f"max_{m}"))
        if both:
            limits.append(of(m, F.col("mid") - reach - slack).alias(f"min_{m}"))
    return best.withColumn("low", low).withColumn("mid", mid).groupBy(F.col("lang").alias("of_lang"), F.col("source").alias("of_source")).agg(*limits)


def apply_rules(docs: DataFrame, carry_columns: bool = False, min_rows: int = 200, width: float = 4.0, accuracy: float = 0.01,
                min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Each document's counts, ``base_failed``, ``failed`` (the measures out of their group's range) and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` per cent of the words in repeated
    8-word windows; such rows are left out of the sketches. Null languages or sources form groups of their own. Null and empty
    texts fail the base rule. Repeated rows are judged alike, an empty table gives an empty result, and columns with the names made here
    are replaced. With ``carry_columns`` the input's columns stay, else only ``doc_id``, ``lang`` and ``source``.

    Counts are stored between the two uses, but not with texts beside them: then they are worked out twice.

    Sketches are built where the rows lie and merged after, so a hot source sends one sketch a task. They are counts, so that limits do not depend
    on the order or the number of tasks, nor on a task that is run again. The limits join on
    language and source: a small side that Spark broadcasts below its own threshold and else joins with skew splitting.
    """
    rows = with_counts(docs)
    if not carry_columns:
        rows = stored(rows.select("doc_id", "lang", "source", *COUNTS), "quality_counts")
    rows = rows.drop("base_failed", "failed", "kept")
    rows = rows.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    shares = {m: _share(top, base) for m, (top, base, _, _) in MEASURES.items()}
    usual = rows.where("not base_failed").select("lang", "source", *(c.alias(m) for m, c in shares.items()))
    limits = group_limits(usual, min_rows, width, accuracy)
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    out_of_range = [F.when((shares[m] > F.col(f"max_{m}")) | ((shares[m] < F.col(f"min_{m}")) if both else F.lit(False)), F.lit(m))
                    for m, (_, _, _, both) in MEASURES.items()]
    failed = F.array_compact(F.array(*out_of_range))
    return (joined.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
            .select(*rows.columns, "failed", "kept"))


def keep_good(docs: DataFrame, **settings: float) -> DataFrame:
    """The rows of ``docs`` that the rules keep, as they are."""
    own = ("doc_id", "text", "lang", "source")
    return restore(apply_rules(carry(docs, *own), carry_columns=True, **settings).where("kept"), docs, *own)
