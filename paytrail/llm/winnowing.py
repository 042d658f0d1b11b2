"""Winnowing fingerprints, in Spark expressions only.

A text's words (letters and digits, lower case; a text without words is one
token, itself) are hashed with xxhash64, and every run of ``k`` words gets a
cyclic-polynomial rolling hash: rotate and xor, so the next run's hash follows
from the last one's.  Of every ``window`` consecutive hashes the smallest is
kept, the rightmost where several are smallest, with its position.  Two texts
that share a run of ``window + k - 1`` words share a kept hash.

Positions are kept as word numbers.  A text of fewer than ``k`` words has one
hash over all of them; a text of fewer hashes than a window keeps one.

Defined results: a null text is an empty text with an empty fingerprint; the
likeness of two fingerprints is the Jaccard similarity of their hash sets, 1 for
two empty ones and 0 for an empty and a non-empty one; equal texts have equal
fingerprints; repeated rows are each reported.  Neighbouring documents are those
next to each other by (id, xxhash64 of the text, text), null ids first, wherever they
are stored; after the last comes the first; a single document follows itself.  Rows
that are equal in id and text stay in one lot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paytrail.llm.common import let, pick, shuffle_partitions

K = 5
WINDOW = 16
SAMPLE_PER_LOT = 400
WORD = r"[\p{L}\p{N}]+"


def _rotate(x: Column, bits: int) -> Column:
    if bits % 64 == 0:
        return x
    return F.shiftleft(x, bits % 64).bitwiseOR(F.shiftrightunsigned(x, 64 - bits % 64))


def _empty() -> Column:
    return F.array().cast("array<bigint>")


def rolling_hashes(text: Column, k: int = K) -> Column:
    """array<bigint>: the rolling hash of every k-word run."""

    def over(words: Column) -> Column:
        return let(F.transform(words, lambda w: F.xxhash64(w)), runs)

    def runs(h: Column) -> Column:
        def run(i: Column) -> Column:
            out = _rotate(F.get(h, i), k - 1)
            for j in range(1, k):
                out = out.bitwiseXOR(_rotate(F.get(h, i + j), k - 1 - j))
            return out

        short = F.aggregate(h, F.lit(0).cast("bigint"), lambda acc, x: _rotate(acc, 1).bitwiseXOR(x))
        return (F.when(F.size(h) == 0, _empty()).when(F.size(h) <= k, F.array(short))
                .otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - F.lit(k)), run)))

    whole = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(F.lower(whole), F.lit(WORD), F.lit(0))
    return let(found, lambda w: over(F.when((F.size(w) == 0) & (F.length(whole) > 0), F.array(whole)).otherwise(w)))


def winnow(hashes: Column, window: int = WINDOW) -> Column:
    """array<int>: positions kept, ascending, each once."""

    def chosen(rev: Column) -> Column:
        # in the reversed array the rightmost of equal hashes comes first
        def smallest(i: Column) -> Column:
            return let(F.slice(rev, i + 1, window), lambda s: i + F.array_position(s, F.array_min(s)).cast("int") - 1)

        last = F.greatest(F.size(rev) - F.lit(window), F.lit(0))
        spots = F.transform(F.sequence(F.lit(0), last), smallest)
        once = let(spots, lambda p: F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1))))
        return F.when(F.size(rev) == 0, F.array().cast("array<int>")).otherwise(
            F.reverse(F.transform(once, lambda p: F.size(rev) - 1 - p)))

    return let(F.reverse(hashes), chosen)


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """struct(hashes array<bigint>, positions array<int>) of the kept runs, by position."""
    return let(rolling_hashes(text, k), lambda h: let(winnow(h, window), lambda p: F.struct(
        F.transform(p, lambda i: F.get(h, i)).alias("hashes"), p.alias("positions"))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash arrays."""
    return let(F.array_distinct(a), lambda x: let(F.array_distinct(b), lambda y: let(F.size(F.array_intersect(x, y)), lambda both:
        F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(both.cast("double") / (F.size(x) + F.size(y) - both)))))


def as_text(fp: Column) -> Column:
    """``hash@position`` items, comma-separated, hashes in hexadecimal."""
    return F.array_join(F.zip_with(fp["hashes"], fp["positions"], lambda h, p: F.concat(F.lower(F.hex(h)), F.lit("@"), p.cast("string"))), ",")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """(id, n_chars, hashes, positions); row by row, nothing is shuffled."""
    fp = pick(df, id_col, text_col).select(F.col("id").alias(id_col), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
                                           fingerprint(F.col("text"), k, window).alias("fp"))
    return fp.select(id_col, "n_chars", "fp.hashes", "fp.positions")


def _numbers(values: list, kind: str) -> Column:
    """An array of constants as one literal, folded by the optimizer, however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _layout(df: DataFrame, lots: int) -> tuple[list[int], int]:
    """How rows are dealt: the quantiles of the ids (an id that holds several lots' rows stands there several times), and the number
    of lots for null ids: one number a lot.  The quantiles come from about SAMPLE_PER_LOT ids a lot; they decide only how even the
    lots are, never a result.
    """
    n, nulls = df.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull())).first()
    ids = df.select("id").sample(min(1.0, SAMPLE_PER_LOT * lots / max(n, 1)), 7)
    shares = _numbers([i / lots for i in range(1, lots)], "double")
    cuts = ids.agg(F.percentile_approx("id", shares, max(10_000, 4 * lots))).first()[0] or []
    return sorted(cuts), -(-lots * nulls // max(n, 1))


def _lot(layout: tuple[list[int], int]) -> Column:
    """Lot of a row; lots ascend as (id, hash) does.  An id, or null, that holds the rows of m lots is cut into m by its texts' hashes."""
    (points, null_lots), x = layout, F.col("id")
    step = math.isqrt(len(points)) + 1
    cuts, coarse = _numbers(points, "bigint"), _numbers(points[::step], "bigint")

    def below(test) -> Column:
        """How many cuts pass, of which the first ones do: first among the coarse, then in the stretch between two of them."""
        return let(F.size(F.filter(coarse, test)), lambda b: F.when(b == 0, F.lit(0)).otherwise(
            (b - 1) * step + F.size(F.filter(F.slice(cuts, (b - 1) * step + 1, F.lit(step)), test))))

    def part(m: Column) -> Column:
        share = F.col("hash").cast("double") / F.lit(2.0 ** 64) + 0.5
        return F.greatest(F.least(F.floor(share * m).cast("int"), m - 1), F.lit(0))

    known = let(below(lambda c: c < x), lambda low: low + part(below(lambda c: c <= x) - low))
    return F.when(x.isNull(), part(F.lit(null_lots)) - null_lots).otherwise(known)


def with_next(df: DataFrame, derive: dict[str, Column], lots: int) -> DataFrame:
    """(id, text, derived columns) with ``next_text`` and ``next_<derived>`` of the next row by (id, hash of the text, text).

    One shuffle into lots of neighbouring rows.  The first row of every lot is copied behind the last row of the lot before:
    a scan finds the first id of each lot, a window over these (one row a lot) the lot before, and the rows with that id are met
    by a broadcast join of one row a lot.
    """
    lots = max(2, lots)
    src = df.select("id", "text", F.xxhash64("text").alias("hash")).withColumn("lot", _lot(_layout(df, lots)))
    heads = src.groupBy("lot").agg(F.min("id").alias("least"), F.max(F.col("id").isNull()).alias("null"))
    ring = Window.orderBy("lot")
    heads = heads.select(F.col("lot").alias("head_lot"), F.when(~F.col("null"), F.col("least")).alias("head_id"),
                         F.coalesce(F.lag("lot").over(ring), F.max("lot").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    first = (src.join(F.broadcast(heads), (F.col("lot") == F.col("head_lot")) & F.col("id").eqNullSafe(F.col("head_id")))
             .groupBy("before").agg(F.min(F.struct("id", "hash", F.col("text").isNotNull().alias("known"), "text")).alias("f"))
             .select("f.id", "f.text", "f.hash", F.col("before").alias("lot"), F.lit(True).alias("behind")))
    rows = src.withColumn("behind", F.lit(False)).unionByName(first).select("*", *[c.alias(n) for n, c in derive.items()])
    order = Window.partitionBy("lot").orderBy("behind", F.col("id").asc_nulls_first(), "hash", F.col("text").asc_nulls_first())
    names = ["text", *derive]
    return rows.select("*", *[F.lead(n).over(order).alias(f"next_{n}") for n in names]).filter(~F.col("behind")).drop("lot", "hash", "behind")


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last quarter of its code points replaced by as many
    of the next document's first ones), with the likeness to the edited text and to the next document."""
    spark = df.sparkSession
    src = pick(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    both = with_next(src, {"fp": fingerprint(F.col("text"), k, window)}, shuffle_partitions(spark))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    out = both.select(F.col("id"), n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", F.col("next_fp.hashes").alias("next_hashes"))
    return let_columns(out, id_col, k, window)


def let_columns(out: DataFrame, id_col: str, k: int, window: int) -> DataFrame:
    """The edited text's fingerprint, bound once per row, and all columns that use it."""
    def result(e: Column) -> Column:
        return F.struct(
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(e).alias("edited_fingerprint"),
            likeness(F.col("fp.hashes"), e["hashes"]).alias("near_edited"), likeness(F.col("fp.hashes"), F.col("next_hashes")).alias("near_next"))

    found = out.select("id", "n_chars", let(fingerprint(F.col("edited"), k, window), result).alias("r"))
    return found.select(F.col("id").alias(id_col), "n_chars", "r.*")
