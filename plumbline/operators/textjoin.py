"""Join of short texts with the longer texts that contain them, without comparing every pair."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import few_or_merged, written

WIDEST = 64    # characters of the longest window; longer needles are found by one of their windows
BLOCK = 4096   # window starts of a text that one row holds


def windows(text: Column, size: Column | int, starts: int | None = None) -> Column:
    """Hashes of the windows of one size, in order of their starts: all of them, or the first ``starts``."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.char_length(text) - size + 1
    last = last if starts is None else F.least(last, F.lit(starts))
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.substring(text, i, size)))


def window_size(needle: Column) -> Column:
    """The largest power of two that fits the needle, at most :data:`WIDEST`."""
    powers = [1 << k for k in range(WIDEST.bit_length())]
    out = F.lit(1)
    for p in powers[1:]:
        out = F.when(F.char_length(needle) >= p, p).otherwise(out)
    return out


def chosen_windows(needles: DataFrame) -> DataFrame:
    """needle, window: of each needle the window that fewest needles share, so that a form they have in common is not what finds them."""
    each = needles.select("needle", F.explode(F.array_distinct(windows(F.col("needle"), F.col("size")))).alias("window"))
    shared = each.groupBy("window").agg(F.count(F.lit(1)).alias("n"))
    best = each.join(shared.hint("merge"), "window").groupBy("needle").agg(F.min(F.struct("n", "window")).alias("best"))
    return best.select("needle", F.col("best.window").alias("window"))


def pieces(text: Column, reach: int) -> Column:
    """A text in pieces of :data:`BLOCK` characters, each with the ``reach`` characters that follow it; cut in one pass."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{BLOCK}}})"), F.lit(1))
    whole = F.char_length(text) <= BLOCK
    return F.when(whole, F.array(text)).otherwise(
        F.transform(cut, lambda piece, i: F.concat(piece, F.left(F.coalesce(F.get(cut, i + 1), F.lit("")), F.lit(reach)))))


def met_pairs(wanted: DataFrame, every: DataFrame) -> DataFrame:
    """Distinct (needle, key): texts that hold the chosen window of a needle. ``wanted``: needle, size. ``every``: text, key.

    A text gives many windows, which estimates of size do not see, so which side is broadcast is not left to them: needles are written and
    counted, and broadcast if they are few. Otherwise both sides are merged.
    """
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())
    if not sizes:
        return wanted.select("needle", F.lit(None).cast("bigint").alias("key"))
    cut = every.select("key", F.explode(pieces(F.col("text"), sizes[-1] - 1)).alias("piece"))
    marks = F.array_distinct(F.flatten(F.array(*[windows(F.col("piece"), n, BLOCK) for n in sizes])))
    found = few_or_merged(written(chosen_windows(wanted), "windows"))
    return cut.select("key", F.explode(marks).alias("window")).join(found, "window").select("needle", "key").distinct()


def contains_pairs(needles: DataFrame, needle: str, texts: DataFrame, text: str) -> DataFrame:
    """Distinct (needle, text) pairs where the text contains the needle; nulls and empty texts on either side take no part.

    A text gives the hashes of its windows of at most seven sizes, the powers of two up to :data:`WIDEST`, however many lengths the
    needles have; a long text gives them in pieces, and only its hash travels with them. A needle is looked up by one window,
    and what it meets is compared with the text itself, so hashes that collide cost a comparison and nothing else. Where needles have
    windows of their own, no more is compared than the texts have windows. The sizes in use, at most seven numbers, pass the driver.
    """
    wanted = (needles.select(F.col(needle).alias("needle")).where(F.char_length("needle") > 0).distinct()
              .withColumn("size", window_size(F.col("needle"))))
    every = texts.select(F.col(text).alias("text")).where(F.char_length("text") > 0).distinct().withColumn("key", F.xxhash64("text"))
    return met_pairs(wanted, every).hint("merge").join(every, "key").where(F.instr("text", F.col("needle")) > 0).select("needle", "text")
