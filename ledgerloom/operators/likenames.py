"""Pairs of names that can reach a least similarity, without comparing all names that share a word letter by letter.

No bound here is below the score that ``entities.compared_names`` gives, so no pair that reaches the least score is left out:
matching blocks are a common subsequence, and a common subsequence is no longer than the letters that both names have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded, cut, discard

#: Left names of one word that meet its right names in one block, pairs that are bounded at once, and rows in a group of blocks.
BLOCK, AT_ONCE, GROUP = 8000, 1 << 21, 50_000
#: Letters, digits and the blank; longer names than ``BITS`` are not bounded by subsequences.
SIGNS, BITS = "abcdefghijklmnopqrstuvwxyz0123456789 ", 64
#: What sums and roundings of scores may differ by.
SLACK = 1e-5

_CODE = np.full(256, len(SIGNS), np.uint8)
_CODE[np.frombuffer(SIGNS.encode(), np.uint8)] = np.arange(len(SIGNS))


class Texts:
    """Texts of signs as arrays: ``length``, ``letters`` (sign x text: how often), ``codes`` (text x place) and ``bits`` (text x sign: its places)."""

    def __init__(self, column: pa.Array):
        raw = [t.encode() for t in column.to_pylist()]
        self.length = np.array([len(t) for t in raw], np.int32)
        n, flat = len(raw), _CODE[np.frombuffer(b"".join(raw), np.uint8)]
        row = np.repeat(np.arange(n), self.length)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        count = np.zeros((len(SIGNS) + 1, n), np.int32)
        np.add.at(count, (flat, row), 1)
        self.letters = np.minimum(count[:-1], 255).astype(np.uint8)
        # signs beyond 255 of a kind are taken to be in the other text too
        self.over = (count[:-1] - self.letters).sum(0, dtype=np.int32)
        on = place < BITS
        self.codes = np.full((n, BITS), len(SIGNS), np.uint8)
        self.codes[row[on], place[on]] = flat[on]
        self.bits = np.zeros((n, len(SIGNS) + 1), np.uint64)
        np.bitwise_or.at(self.bits, (row[on], flat[on]), np.left_shift(np.uint64(1), place[on].astype(np.uint64)))


def letters_ratio(a: Texts, i: np.ndarray, b: Texts, j: np.ndarray) -> np.ndarray:
    """(i x j) upper bound of the ratio by the letters that both texts have."""
    same = np.zeros((len(i), len(j)), np.uint16)
    left, right = a.letters[:, i], b.letters[:, j]
    for s in np.flatnonzero(left.any(1) & right.any(1)):
        same += np.minimum(left[s][:, None], right[s][None, :])
    most = same.astype(np.float32) + (a.over[i][:, None] + b.over[j][None, :])
    return 2 * most / np.maximum(a.length[i][:, None] + b.length[j][None, :], 1)


def subsequence_ratio(a: Texts, i: np.ndarray, b: Texts, j: np.ndarray) -> np.ndarray:
    """Upper bound of the ratio of each pair (i[n], j[n]) by its longest common subsequence; 1 for long texts."""
    v = np.full(len(i), ~np.uint64(0))
    for k in range(min(BITS, int(b.length[j].max(initial=0)))):
        u = v & a.bits[i, b.codes[j, k]]
        v = (v + u) | (v - u)
    both = a.length[i] + b.length[j]
    ratio = 2 * np.bitwise_count(~v) / np.maximum(both, 1)
    return np.where((a.length[i] > BITS) | (b.length[j] > BITS) | (both == 0), 1.0, ratio)


def _lists(column: pa.Array) -> tuple[np.ndarray, list[list]]:
    rows = column.to_pylist()
    return np.array([len(r) for r in rows], np.int32), rows


def like_names(left: DataFrame, right: DataFrame, least: float, alike: str) -> DataFrame:
    """(l_id, r_id): pairs of two tables that share a word and whose name score can reach ``least``.

    Tables have id (long), words (distinct words that join), full, core (texts), anchor (distinct words whose overlap counts) and kind (text: the regions named).
    ``alike``: "same" asks for the same kind, "other" for another kind, "any" for neither.

    Words of many names are cut into blocks of at most ``BLOCK`` left names, each with all right names of the word; only names of kinds that may meet are paired.
    """
    fields = ["id", "full", "core", "anchor", "kind"]
    a, b = (df.select(*fields, F.explode("words").alias("w")) for df in (left, right))
    of = lambda df, s: df.groupBy("w").agg(F.count("*").alias(f"n{s}"), F.min("kind").alias(f"least_{s}"), F.max("kind").alias(f"most_{s}"))
    sizes = of(a, "a").join(of(b, "b"), "w")
    if alike == "other":
        # words whose names are all of one kind bring nothing
        sizes = sizes.where((F.least("least_a", "least_b") != F.greatest("most_a", "most_b")))
    sizes = sizes.withColumn("salts", F.ceil(F.col("na") / BLOCK).cast("int"))
    rows = sizes.agg(F.sum(F.col("na") + F.col("nb") * F.col("salts"))).first()[0] or 0
    if not rows:
        return left.sparkSession.createDataFrame([], "l_id long, r_id long")
    groups = max(2 * left.sparkSession.sparkContext.defaultParallelism, -(-rows // GROUP))
    salts = sizes.select("w", "salts")
    group = F.pmod(F.xxhash64("w", "salt"), F.lit(groups)).alias("g")
    a = a.join(salts, "w").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    b = b.join(salts, "w").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    block = F.concat_ws(" ", "w", "salt").alias("block")
    a, b = a.select(*fields, group, block), b.select(*fields, group, block)
    overlap = (least - 0.6) / 0.4 if least > 0.6 else 0.0

    def sides(t: pa.Table) -> tuple:
        t = t.combine_chunks()
        one = lambda c: (t[c].combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type))
        order: dict[str, list[int]] = {}
        for n, k in enumerate(one("block").to_pylist()):
            order.setdefault(k, []).append(n)
        return one("id").to_numpy(), Texts(one("full")), Texts(one("core")), *_lists(one("anchor")), np.array(one("kind").to_pylist(), object), order

    def shared(i: np.ndarray, j: np.ndarray, of_a: list, of_b: list) -> np.ndarray:
        """(i x j) the number of words that both have."""
        at: dict[str, tuple[list, list]] = {}
        for side, (rows_, of) in enumerate(((i, of_a), (j, of_b))):
            for n, r in enumerate(rows_):
                for w in of[r]:
                    at.setdefault(w, ([], []))[side].append(n)
        both = np.zeros((len(i), len(j)), np.uint16)
        for x, y in at.values():
            if len(x) == len(i) and len(y) == len(j):
                both += 1
            elif x and y:
                both[np.ix_(x, y)] += 1
        return both

    def meeting(i: np.ndarray, j: np.ndarray, a_kind: np.ndarray, b_kind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in [None] if alike == "any" else np.unique(a_kind[i]):
            yield (i, j) if k is None else (i[a_kind[i] == k], j[(b_kind[j] == k) == (alike == "same")])

    def found(x: pa.Table, y: pa.Table) -> pa.Table:
        a_id, a_full, a_core, a_size, a_words, a_kind, a_at = sides(x)
        b_id, b_full, b_core, b_size, b_words, b_kind, b_at = sides(y)
        codes = {k: n for n, k in enumerate({*a_kind, *b_kind})}
        a_kind, b_kind = (np.array([codes[k] for k in c], np.int32) for c in (a_kind, b_kind))
        hits: list[np.ndarray] = []
        for key in a_at.keys() & b_at.keys():
            for all_a, j in meeting(np.array(a_at[key]), np.array(b_at[key]), a_kind, b_kind):
                if not len(j):
                    continue
                step = max(1, AT_ONCE // len(j))
                for start in range(0, len(all_a), step):
                    i = all_a[start : start + step]
                    both = shared(i, j, a_words, b_words)
                    sums = a_size[i][:, None] + b_size[j][None, :]
                    near = both * np.float32(1 + overlap) >= (overlap * sums - SLACK).astype(np.float32)
                    r, c = np.flatnonzero(~near.all(1)), np.flatnonzero(~near.all(0))
                    near[np.ix_(r, c)] |= letters_ratio(a_full, i[r], b_full, j[c]) >= least - SLACK
                    n, m = np.nonzero(near)
                    if not len(n):
                        continue
                    jaccard = both[n, m] / np.maximum(sums[n, m] - both[n, m], 1)
                    p, q = i[n], j[m]
                    good = subsequence_ratio(a_full, p, b_full, q) >= least - SLACK
                    rest = np.flatnonzero(~good & (jaccard >= overlap - SLACK))
                    good[rest] = 0.6 * subsequence_ratio(a_core, p[rest], b_core, q[rest]) + 0.4 * jaccard[rest] >= least - SLACK
                    hits.append(np.stack([a_id[p[good]], b_id[q[good]]]))
        ids = np.unique(np.concatenate(hits, 1), axis=1) if hits else np.zeros((2, 0), np.int64)
        return pa.table({"l_id": ids[0].astype(np.int64), "r_id": ids[1].astype(np.int64)})

    return a.groupBy("g").cogroup(b.groupBy("g")).applyInArrow(found, "l_id long, r_id long").distinct()


def contained_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_id, r_id): pairs of two tables (as for ``like_names``) of the same kind where the smaller ``anchor`` has 0.8 of its words in the other and cores can be 0.8 alike.

    Of the m words of the smaller anchor at most e = m - 0.8 m are missing in the other, so two of any e + 2 are there. The e + 2 rarest of each name
    are taken, two at a time, and names of the other table come by all their words, two at a time: no pairs are formed by the common words of longer names.
    Names of one word come by that word. What two such names share is then bounded by two bits a word, and their likeness by the longest subsequence.
    """
    names = [df.select("id", "kind", "core", "anchor").where(F.size("anchor") > 0) for df in (left, right)]
    words = names[0].select(F.lit(0).alias("side"), "id", F.explode("anchor").alias("w")).unionByName(names[1].select(F.lit(1).alias("side"), "id", F.explode("anchor").alias("w")))
    known = words.groupBy("w").agg(F.count("*").alias("n"))
    ranked = words.join(known, "w").groupBy("side", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: F.xxhash64(x["w"])).alias("codes"))
    of = names[0].select(F.lit(0).alias("side"), "id", "kind", F.length("core").alias("n")).unionByName(names[1].select(F.lit(1).alias("side"), "id", "kind", F.length("core").alias("n")))
    bits = [F.expr(f"aggregate(codes, 0L, (s, c) -> s | shiftleft(1L, cast(pmod(shiftright(c, {at}), 64) AS int)))").alias(f"bits{at}") for at in (0, 8)]
    size = F.size("codes")
    every = cut(ranked.join(of, ["side", "id"]).select("side", "id", "n", size.alias("m"), (size - F.ceil(size * 4 / 5).cast("int")).alias("e"), F.xxhash64("kind").alias("kind"), *bits, "codes"))
    twos = "flatten(transform(sequence(1, size({0}) - 1), i -> transform(slice({0}, i + 1, size({0})), c -> c ^ {0}[i - 1] ^ kind)))"
    pairs = []
    for n, m in ((0, 1), (1, 0)):
        x, y = every.where(F.col("side") == n), every.where(F.col("side") == m)
        some = x.where("m > 1").withColumn("codes", F.slice("codes", F.lit(1), F.col("e") + 2))
        by_two = some.select(F.expr(f"explode({twos.format('codes')})").alias("key"), "id", "n", "m", "e", "bits0", "bits8")
        of_two = y.where("m > 1").select(F.expr(f"explode({twos.format('codes')})").alias("key"), F.col("id").alias("y"), F.col("n").alias("yn"), F.col("m").alias("ym"), F.col("bits0").alias("ybits0"), F.col("bits8").alias("ybits8"))
        by_one = x.where("m = 1").select(F.expr("codes[0] ^ kind").alias("key"), "id", "n", "m", "e", "bits0", "bits8")
        of_one = y.select(F.expr("explode(transform(codes, c -> c ^ kind))").alias("key"), F.col("id").alias("y"), F.col("n").alias("yn"), F.col("m").alias("ym"), F.col("bits0").alias("ybits0"), F.col("bits8").alias("ybits8"))
        for few, many in ((by_two, of_two), (bounded(by_one), of_one)):
            # equal sizes meet from the left
            near = few.join(many, "key").where(f"{'m <= ym' if n == 0 else 'm < ym'} AND 3 * least(n, yn) >= 2 * greatest(n, yn) AND bit_count(bits0 & ~ybits0) <= e AND bit_count(bits8 & ~ybits8) <= e")
            pairs.append(near.select(F.col("id" if n == 0 else "y").alias("l_id"), F.col("y" if n == 0 else "id").alias("r_id")))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.arange(b.num_rows)
            good = np.flatnonzero(subsequence_ratio(Texts(b.column(2)), at, Texts(b.column(3)), at) >= 0.8 - SLACK)
            yield b.select(["l_id", "r_id"]).take(pa.array(good))

    # by left names at once, for each pair once and for the join that follows
    found = reduce(DataFrame.unionByName, pairs).repartition("l_id").distinct()
    for s, df in zip("lr", names, strict=True):
        found = found.join(df.select(F.col("id").alias(f"{s}_id"), F.col("core").alias(s)), f"{s}_id")
    found = cut(found.select("l_id", "r_id", "l", "r").mapInArrow(alike, "l_id long, r_id long"))
    discard(every)
    return found
