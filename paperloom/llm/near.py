"""Near-duplicate texts: MinHash bands, odd sketches, exact check.

Words are the longest runs of a-z and 0-9 in the lower-cased text; a text's set
is the set of its sequences of ``width`` consecutive words; similarity is the
Jaccard similarity of two sets.  Null texts and texts of fewer than ``width``
words have no set and are in no pair.

1. A task per slice of texts makes K MinHash samples, their band keys and an
   odd sketch: the samples fold into a bitmap of parities.
2. Texts with equal sets are one class; only its representative goes on.
3. Representatives that share a band are candidates.  A band that very many
   share says little and would give pairs without number: its members are
   compared by their rarest sequences instead, which misses no pair.
4. The XOR of two odd sketches has a population count that estimates the
   similarity; candidates clearly below the threshold are dropped.
5. The rest are compared exactly on the sets of the texts themselves.

With R rows in each of B bands a pair of similarity s is a candidate with
probability 1 - (1 - s^R)^B.  ``scheme`` takes, for a threshold, the largest R
that misses a pair at it with a probability of at most 2e-5 with no more than
320 samples: 78 bands of 4 for 0.6, 36 bands of 6 for 0.8.  The bound of step 4
is six standard deviations of the estimate below the threshold.
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from paperloom.arrow import BYTES, I, L, S, batch, rows
from paperloom.llm.filters import likely
from paperloom.session import materialise

import pyarrow as pa

WORD = re.compile("[a-z0-9]+")
#: Samples of one text at most, and the probability at most with which a pair at the threshold is missed.
K, MISSED = 320, 2e-5
SKETCH_BITS = 1024
#: Members of a band up to which their pairs are formed.
HOT = 1000
#: Counters of sequences, by hash: a constant size, whatever the number of texts.
COUNTERS = 1 << 20
_U32 = np.uint32


def shingles(text: str, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of the text's word sequences, sorted."""
    words = WORD.findall(text.lower())
    if len(words) < width:
        return np.empty(0, np.uint64)
    ids = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    h = np.fromiter((ids[w] for w in words), np.uint64, len(words))
    out = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (h[i : len(h) - width + 1 + i] ^ (h[i : len(h) - width + 1 + i] >> np.uint64(29)))
    out ^= out >> np.uint64(32)
    return np.unique(out)


def scheme(threshold: float, most: int = K, missed: float = MISSED) -> tuple[int, int]:
    """(samples, rows of a band) for a threshold: the sharpest bands that ``most`` samples allow."""
    best = (most, 1)
    for r in range(1, most + 1):
        bands = math.ceil(math.log(missed) / math.log1p(-(threshold**r))) if threshold < 1 else 1
        if bands * r > most:
            break
        best = (bands * r, r)
    return best


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(0, 2**32, k, dtype=np.uint64).astype(_U32) | _U32(1)), rng.integers(0, 2**32, k, dtype=np.uint64).astype(_U32)


def minhash(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (sh ^ (sh >> np.uint64(31))).astype(_U32)
    x ^= x >> _U32(16)
    x *= _U32(0x85EBCA6B)
    x ^= x >> _U32(13)
    out = np.full(len(a), 0xFFFFFFFF, _U32)
    for i in range(0, len(x), 512):  # blocks that stay in the cache
        np.minimum(out, (x[i : i + 512, None] * a + b).min(axis=0), out=out)
    return out


def _mix(v: np.ndarray) -> np.ndarray:
    v = v * np.uint64(0xFF51AFD7ED558CCD)
    v ^= v >> np.uint64(33)
    v *= np.uint64(0xC4CEB9FE1A85EC53)
    return v ^ (v >> np.uint64(33))


def odd_sketch(mins: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Bit p is the parity of the samples (number, value) that hash to p."""
    at = (_mix(mins.astype(np.uint64) + (np.arange(len(mins), dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1).astype(np.uint8).tobytes()


def estimate(a: bytes, b: bytes, k: int = K) -> float:
    """Similarity from the population count of the XOR: 1 + n/4k ln(1 - 2 count/n)."""
    n = 8 * len(a)
    odd = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return 0.0 if 2 * odd >= n else 1 + n / (4 * k) * float(np.log(1 - 2 * odd / n))


def slack(threshold: float, k: int = K, bits: int = SKETCH_BITS) -> float:
    """Six standard deviations of the estimate: of the samples, and of the folding."""
    e = np.exp(4 * k * (1 - threshold) / bits)
    fold = (bits / (4 * k)) * np.sqrt((e * e - 1) / bits)
    return 6 * float(np.sqrt(threshold * (1 - threshold) / k + fold**2))


def signatures(texts: DataFrame, width: int, k: int, r: int) -> DataFrame:
    """(id, set_hash, n, bands, sketch) of each distinct (id, set) of ``texts`` (id, text)."""

    def run(batches):
        a, b = _seeds(k)
        for bt in batches:
            out = []
            for i, text in rows(bt, "id", "text"):
                sh = shingles(text, width)
                if len(sh):
                    m = minhash(sh, a, b)
                    g = m.reshape(-1, r).astype(np.uint64)
                    key = _mix(np.arange(len(g), dtype=np.uint64))  # keys of different bands differ
                    for c in range(r):
                        key = _mix(key ^ (g[:, c] + np.uint64(c + 1)))
                    out.append((i, xxhash.xxh3_64_intdigest(sh.tobytes()) - 2**63, len(sh), key.view(np.int64), odd_sketch(m)))
            yield batch(out, ["id", "set_hash", "n", "bands", "sketch"], [S, L, I, pa.list_(L), BYTES])

    made = texts.where("text IS NOT NULL AND text <> ''").select(F.col("id").cast("string").alias("id"), "text")
    return made.mapInArrow(run, "id string, set_hash bigint, n int, bands array<bigint>, sketch binary")


_PAIR, _EDGE, _HOT = 0, 1, 2


def _band_runs(batches):
    """Pairs of the ids that share a key, from rows (key, id) sorted by both; for mapInArrow.

    Rows (kind, key, a, b): pairs of the runs of one key that lie within the
    task; ids of the first and last run, which may go on in another task; and
    keys of more than HOT ids.  No more than HOT ids of a key are held.
    """
    names, types = ["kind", "key", "a", "b"], [I, L, L, L]

    def out(kind, key, a, b):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind), I), pa.array(np.full(n, key) if np.isscalar(key) else key, L), pa.array(a, L), pa.array(b, L)], names=names)

    def edge(run):
        key, ids, n = run
        if n > HOT:
            return out(_HOT, key, np.zeros(1, np.int64), np.zeros(1, np.int64))
        a = np.concatenate(ids)
        return out(_EDGE, key, a, a)

    held, first = None, True  # the last run so far: key, ids, number
    for batch_ in batches:
        key, ids = np.asarray(batch_.column("key")), np.asarray(batch_.column("id"))
        if not len(key):
            continue
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        if held is not None and held[0] == key[0]:
            held = (held[0], [*held[1], ids[: ends[0]]] if held[2] + ends[0] <= HOT else [], held[2] + int(ends[0]))
            starts, ends = starts[1:], ends[1:]
        if not len(starts):
            continue
        done = [] if held is None else [held]
        several = (ends - starts > 1) & (np.arange(len(starts)) < len(starts) - 1)
        if first and held is None and len(starts) > 1:
            done, several[0] = [(int(key[0]), [ids[: ends[0]]] if ends[0] <= HOT else [], int(ends[0]))], False
        pairs = []
        for run in done:
            if first:
                yield edge(run)
                first = False
            elif run[2] > HOT:
                yield edge(run)
            elif run[2] > 1:
                a = np.concatenate(run[1])
                i, j = np.triu_indices(len(a), 1)
                pairs.append((a[i], a[j]))
        for s, e in zip(starts[several], ends[several]):
            if e - s > HOT:
                yield edge((int(key[s]), [], int(e - s)))
            else:
                i, j = np.triu_indices(e - s, 1)
                pairs.append((ids[s:e][i], ids[s:e][j]))
        if pairs:
            yield out(_PAIR, 0, np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs]))
        s = starts[-1]
        held = (int(key[s]), [ids[s:]] if len(ids) - s <= HOT else [], len(ids) - int(s))
    if held is not None:
        yield edge(held)


def _candidates(texts: DataFrame, sig: DataFrame, reps: DataFrame, width: int, threshold: float) -> DataFrame:
    """Distinct (a, b), a < b, of representatives that share a band, or rare sequences where the band has very many.

    Keys are sorted by ranges, with their ids, so that the members of a hot
    band are spread over tasks; only what lies at the ends of a task is looked
    at again.
    """
    keyed = reps.select(F.explode("bands").alias("key"), "id")
    ordered = keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    got = materialise(ordered.mapInArrow(_band_runs, "kind int, key bigint, a bigint, b bigint"))
    edge = got.where(f"kind = {_EDGE}").select("key", "a")
    hot = got.where(f"kind = {_HOT}").select("key").distinct().unionByName(edge.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key")).distinct()
    hot = materialise(hot)
    edge = edge.join(hot, "key", "left_anti")
    across = edge.join(edge.select("key", F.col("a").alias("b")), "key").where("a < b").select("a", "b")
    pairs = got.where(f"kind = {_PAIR}").select("a", "b").unionByName(across)
    if not hot.isEmpty():
        many = materialise(keyed.join(hot, "key", "left_semi").select(F.col("id").alias("set_hash")).distinct())
        pairs = pairs.unionByName(_rare_pairs(texts, sig, many, width, threshold))
    return pairs.distinct()


def _sets(texts: DataFrame, sig: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(set_hash, sh): the sets of ``wanted`` (set_hash), each read again from one of its texts."""
    one = sig.join(wanted, "set_hash", "left_semi").groupBy("set_hash").agg(F.min("id").alias("id"))

    def run(batches):
        for b in batches:
            out = []
            for _, text in rows(b, "id", "text"):
                sh = shingles(text, width)
                out.append((xxhash.xxh3_64_intdigest(sh.tobytes()) - 2**63, sh.view(np.int64)))
            yield batch(out, ["set_hash", "sh"], [L, pa.list_(L)])

    one = materialise(one.select("id").distinct())
    held = texts.where("text IS NOT NULL AND text <> ''").select(F.col("id").cast("string").alias("id"), "text")
    # only texts that are likely wanted are shuffled
    held = likely(held, one, "id").join(one, "id", "left_semi")
    return held.mapInArrow(run, "set_hash bigint, sh array<bigint>").join(wanted, "set_hash", "left_semi").dropDuplicates(["set_hash"])


def _rare_pairs(texts: DataFrame, sig: DataFrame, wanted: DataFrame, width: int, threshold: float) -> DataFrame:
    """Distinct (a, b), a < b, of the sets of ``wanted`` that share one of their rarest sequences.

    Of two sets of similarity t or more, each has a sequence of the other among
    its n - ceil(t n) + 1 first ones in any order that is the same for all
    sets.  The order is by how often a sequence occurs, counted by hash.
    """
    sets = materialise(_sets(texts, sig, wanted, width))
    spot = F.pmod("s", F.lit(COUNTERS)).cast("int")
    counted = sets.select(F.explode("sh").alias("s")).groupBy(spot.alias("at")).agg(F.count("*").alias("n")).toArrow()
    often = np.zeros(COUNTERS, np.int64)
    often[counted["at"].to_numpy()] = counted["n"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        often = shared.value
        for b in batches:
            out = []
            for i, sh in zip(b.column("set_hash").to_pylist(), b.column("sh")):
                s = np.asarray(sh.values)
                first = np.lexsort((s, often[s % COUNTERS]))[: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1]
                out += [(i, x, len(s)) for x in s[first].tolist()]
            yield batch(out, ["id", "s", "n"], [L, L, I])

    first = sets.mapInArrow(run, "id bigint, s bigint, n int")
    left, right = first.select(F.col("id").alias("a"), "s", F.col("n").alias("na")), first.select(F.col("id").alias("b"), "s", F.col("n").alias("nb"))
    return left.join(right, "s").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("a", "b").distinct()


def links(texts: DataFrame, width: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (id, rep) gives the representative of each text's set;
    pairs (a, b, similarity) are all representatives, a < b, of similarity at least ``threshold``.

    ``texts`` has ``id`` and ``text``; the same id with the same text counts
    once.  Texts with equal sets are linked by having one representative.
    """
    k, r = scheme(threshold)
    sig = materialise(signatures(texts, width, k, r))
    rep = sig.groupBy("set_hash").agg(F.min("id").alias("rep"))
    members = sig.select("id", "set_hash").distinct().join(rep, "set_hash").select("id", "set_hash", "rep")
    # a representative is named by its set, as one id may come with several texts
    # most sets have one text, and its bands stay where they are
    several = materialise(sig.groupBy("set_hash").agg(F.count("*").alias("copies")).where("copies > 1").select("set_hash"))
    reps = sig.select(F.col("set_hash").alias("id"), "bands", "sketch", "n")
    among = several.withColumnRenamed("set_hash", "id")
    reps = materialise(reps.join(among, "id", "left_anti").unionByName(reps.join(among, "id", "left_semi").dropDuplicates(["id"])))
    cand = _candidates(texts, sig, reps, width, threshold)
    floor = threshold - slack(threshold, k)

    def sketched(batches):
        for b in batches:
            out = [(x, y) for x, y, s, t, m, n in rows(b, "a", "b", "sa", "sb", "na", "nb") if min(m, n) >= threshold * max(m, n) and estimate(s, t, k) >= floor]
            yield batch(out, ["a", "b"], [L, L])

    sk = reps.select("id", "sketch", "n")
    near = cand.join(sk.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a").join(sk.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb")), "b")
    near = materialise(near.mapInArrow(sketched, "a bigint, b bigint"))
    pairs = _verified(texts, sig, near, width, threshold)
    return members, pairs


def _verified(texts: DataFrame, sig: DataFrame, near: DataFrame, width: int, threshold: float) -> DataFrame:
    """Exact similarity of the pairs; only the texts in some pair are read into sets again."""
    wanted = near.select(F.explode(F.array("a", "b")).alias("set_hash")).distinct()
    held = _sets(texts, sig, wanted, width)
    x, y = held.select(F.col("set_hash").alias("a"), F.col("sh").alias("x")), held.select(F.col("set_hash").alias("b"), F.col("sh").alias("y"))
    both = near.join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), F.size("x").alias("m"), F.size("y").alias("n"))
    exact = both.select("a", "b", (F.col("common") / (F.col("m") + F.col("n") - F.col("common"))).alias("similarity"))
    return exact.where(F.col("similarity") >= threshold)


def id_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the links of all ids, those of equal sets included."""
    m = members.select("id", "set_hash").distinct()
    same = m.groupBy("set_hash").agg(F.count("*").alias("n")).where("n > 1").select("set_hash")
    x = m.join(same, "set_hash", "left_semi")
    equal = x.withColumnRenamed("id", "p").join(x.withColumnRenamed("id", "q"), "set_hash").where("p < q").select("p", "q")
    a = m.select(F.col("set_hash").alias("a"), F.col("id").alias("p"))
    b = m.select(F.col("set_hash").alias("b"), F.col("id").alias("q"))
    other = pairs.join(a, "a").join(b, "b").where("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    return equal.unionByName(other).distinct().select(F.col("p").alias("id_a"), F.col("q").alias("id_b"))


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, links): the connected group of each id and the links of its set to other sets.

    Groups grow by taking the smallest label around, with a shortcut to the
    label's own label, so that chains take rounds of the logarithm of their
    length.  Each round is written to the shared folder.
    """
    nodes = members.select("set_hash").distinct()
    edges = materialise(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    deg = edges.groupBy("a").agg(F.count("*").alias("links"))
    label = edges.select(F.col("a").alias("v")).distinct().withColumn("l", F.col("v"))
    while True:  # labels only become smaller, so this ends
        low = edges.join(label.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        step = label.join(low, "v").select("v", "l", F.least("l", "m").alias("m"))
        jump = step.join(label.select(F.col("v").alias("m"), F.col("l").alias("mm")), "m", "left")
        step = materialise(jump.select("v", "l", F.least("m", F.coalesce("mm", "m")).alias("m")))
        label = step.select("v", F.col("m").alias("l"))
        if step.where("m < l").isEmpty():
            break
    of = nodes.join(label.withColumnRenamed("v", "set_hash"), "set_hash", "left").select("set_hash", F.coalesce("l", "set_hash").alias("l"))
    of = members.select("id", "set_hash").join(of, "set_hash").join(deg.withColumnRenamed("a", "set_hash"), "set_hash", "left")
    names = of.groupBy("l").agg(F.min("id").alias("class_id"))
    return of.join(names, "l").groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))
