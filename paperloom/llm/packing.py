"""Filling containers of fixed capacity with texts, by a grouping genetic algorithm on islands.

A text is split only if it alone exceeds the capacity: into full containers
and a rest.  Rests and shorter texts of one size can stand for each other, so
what is packed is the number of items of each size, over all rows at once: a
packing is a number of containers for each pattern, and neither grows with the
rows, only with the capacity.  Several islands have populations of their own,
which begin with best fit, largest first.  A crossover takes whole well-filled
containers of one parent into the other, gives up the containers there is no
more supply for, and puts the displaced items back by best fit.  Between epochs
the elite of each island migrates to the next one.  A target is done when it
reaches the lower bound, or when several epochs in a row bring no gain.  At the
end the items of each size are numbered and dealt to the places for that size.

Null texts have no place; an empty text has zero tokens and takes no room.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from paperloom.arrow import I, L, S, batch, rows
from paperloom.session import materialise

ISLANDS = 4
POPULATION = 12
#: An epoch ends after so many children without a gain, the evolution after so many epochs.
PATIENCE = 30
STALLED = 2
#: So many sizes are tried as the first of three items that fill a container, and of two that are swapped in.
TRIES_FILL, TRIES_SWAP = 6, 24
#: So many patterns with room are tried for swaps in one crossover.
SWAPPED = 32
#: Items of one size are numbered in parts of about so many rows, and meet their places in blocks of so many numbers.
PART, BLOCK = 20_000, 64
#: So many targets are packed at once; more are worked off in blocks.
MAX_TARGETS = 1000


def tokenizer_path() -> str:
    """The vocabulary file of the default public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encodings: dict[str, object] = {}


def encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens) of each document with a text."""
    path = path or tokenizer_path()

    def run(batches):
        enc = encoding(path)
        for b in batches:
            yield batch([(d, len(enc.encode_ordinary(t))) for d, t in rows(b, "doc_id", "text")], ["doc_id", "tokens"], [L, L])

    return docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id bigint, tokens bigint")


Bin = tuple[int, tuple[int, ...]]  # what it holds in tokens, and which items


def best_fit(order: list[int], sizes: list[int], cap: int, bins: list[Bin]) -> list[Bin]:
    """Each item in turn goes where it leaves the least room; else it begins a container."""
    room = sorted((cap - used, k) for k, (used, _) in enumerate(bins))
    held = [list(items) for _, items in bins]
    for i in order:
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = cap, len(held)
            held.append([])
        held[k].append(i)
        if left - sizes[i] > 0:
            bisect.insort(room, (left - sizes[i], k))
    return [(sum(sizes[i] for i in h), tuple(h)) for h in held]


Pattern = tuple[tuple[int, int], ...]  # (size, how many of it), largest first


def held(pattern: Pattern) -> int:
    return sum(s * k for s, k in pattern)


def best_fit_counts(supply: Counter, cap: int, start: Counter, order: list[int] | None = None) -> Counter:
    """What ``best_fit`` does with the items of ``supply`` (size to number), for all containers of a pattern at once."""
    rooms: list[int] = []
    at: dict[int, list[tuple[dict[int, int], int]]] = {}
    out: Counter = Counter()

    def put(pattern: dict[int, int], n: int, room: int) -> None:
        if n and not room:
            out[tuple(sorted(pattern.items(), reverse=True))] += n
        elif n:
            if room not in at:
                at[room] = []
                bisect.insort(rooms, room)
            at[room].append((pattern, n))

    for p, n in start.items():
        put(dict(p), n, cap - held(p))
    for s in order or sorted(supply, reverse=True):
        n = supply[s]
        while n > 0:
            i = bisect.bisect_left(rooms, s)
            new = i == len(rooms)
            if new:
                p, c, room = {}, n, cap
            else:
                room = rooms[i]
                p, c = at[room].pop()
                if not at[room]:
                    del at[room], rooms[i]
            k = room // s
            whole = min(c, n // k)
            put({**p, s: p.get(s, 0) + k}, whole, room - k * s)
            n -= whole * k
            if whole < c and n:
                # fewer are left than one container takes
                put({**p, s: p.get(s, 0) + n}, 1, room - n * s)
                whole, n = whole + 1, 0
            if not new:
                put(p, c - whole, room)
    for room in rooms:
        for p, n in at[room]:
            out[tuple(sorted(p.items(), reverse=True))] += n
    return out


def fitness(people: Counter, cap: int) -> tuple[int, float]:
    """The number of containers, then less the mean square of the fill, which prefers full ones beside emptier ones."""
    n = people.total()
    return n, -sum(c * (held(p) / cap) ** 2 for p, c in people.items()) / max(1, n)


def _blurred(supply: Counter, rng: random.Random) -> list[int]:
    return sorted(supply, key=lambda s: -s * (1 - 0.25 * rng.random()))


def _exact(gap: int, most: int, left: Counter, sizes: list[int], rng: random.Random) -> tuple[int, ...] | None:
    """Up to three items of ``left``, none larger than ``most``, that fill ``gap`` exactly; few and large ones first."""

    def two(gap: int, most: int) -> tuple[int, ...] | None:
        if gap <= most and left[gap] > 0:
            return (gap,)
        # the larger of two is at least half of the gap
        for i in range(bisect.bisect_right(sizes, min(most, gap - 1)) - 1, bisect.bisect_left(sizes, (gap + 1) // 2) - 1, -1):
            x = sizes[i]
            if left[x] > 0 and left[gap - x] > (gap - x == x):
                return x, gap - x
        return None

    if found := two(gap, most):
        return found
    firsts = sizes[: bisect.bisect_right(sizes, min(most, gap - 2))]
    for x in sorted(rng.sample(firsts, min(len(firsts), TRIES_FILL)), reverse=True):
        if left[x] > 0:
            left[x] -= 1
            rest = two(gap - x, x)
            left[x] += 1
            if rest:
                return x, *rest
    return None


def filled_counts(supply: Counter, cap: int, start: Counter, order: list[int], rng: random.Random) -> Counter:
    """Each item in turn begins containers that others fill exactly, as long as there are such; best fit places the rest."""
    left, out = Counter(supply), Counter(start)
    sizes = sorted(left)
    for s in order:
        while left[s] > 0:
            left[s] -= 1
            more = () if s == cap else _exact(cap - s, s, left, sizes, rng)
            left[s] += 1
            if more is None:
                break
            need = Counter((s, *more))
            n = min(left[x] // k for x, k in need.items())
            out[tuple(sorted(need.items(), reverse=True))] += n
            for x, k in need.items():
                left[x] -= n * k
    return best_fit_counts(+left, cap, out)


def improved_counts(bins: Counter, left: Counter, cap: int, rng: random.Random | None = None) -> tuple[Counter, Counter]:
    """Containers with room made fuller by swaps with displaced items: one or two for one or two.

    What comes out is smaller than what goes in, so that best fit places it
    more easily.  Some patterns with room are tried, picked by ``rng``.
    Returns the containers and what is left over.
    """
    out, left = Counter(bins), Counter(left)
    roomy = sorted(p for p in bins if held(p) < cap)
    if rng is not None and len(roomy) > SWAPPED:
        roomy = rng.sample(roomy, SWAPPED)
    sizes = sorted(s for s in left if left[s] > 0)
    for p in roomy:
        n, room = out[p], cap - held(p)
        items = [s for s, k in p for _ in range(min(k, 2))]
        outs = sorted({(x,) for x in items} | {tuple(sorted(x)) for x in itertools.combinations(items, 2)})
        while n and sizes:
            best = None
            for gone in outs:
                w = sum(gone)
                # one item, then two, that come closest to the room from below
                i = bisect.bisect_right(sizes, w + room) - 1
                if i >= 0 and sizes[i] > w and (best is None or sizes[i] - w > best[0]):
                    best = (sizes[i] - w, gone, (sizes[i],))
                # the larger of two is at least half of what they fill
                for j in range(i, max(-1, i - TRIES_SWAP), -1):
                    x = sizes[j]
                    if 2 * x <= w:
                        break
                    k = bisect.bisect_right(sizes, w + room - x) - 1
                    if k >= 0 and sizes[k] + x > w and left[sizes[k]] > (k == j) and (best is None or sizes[k] + x - w > best[0]):
                        best = (sizes[k] + x - w, gone, (x, sizes[k]))
                if best is not None and best[0] == room:
                    break
            if best is None:
                break
            _, gone, come = best
            need = Counter(come)
            m = min(n, *(left[x] // k for x, k in need.items()))
            q = Counter(dict(p))
            q.subtract(gone)
            q.update(come)
            out[p] -= m
            out[tuple(sorted((+q).items(), reverse=True))] += m
            for x in need:
                left[x] -= need[x] * m
                if not left[x]:
                    sizes.pop(bisect.bisect_left(sizes, x))
            for x in gone:
                if not left[x]:
                    bisect.insort(sizes, x)
                left[x] += m
            n -= m
    return +out, +left


def ranked(people: Counter) -> list[tuple[int, Pattern]]:
    """The patterns of a packing with what they hold, fullest first."""
    return sorted(((held(p), p) for p in people), key=lambda x: (-x[0], x[1]))


def crossover_counts(a: Counter, b: Counter, supply: Counter, cap: int, rng: random.Random, of_a: list | None = None, of_b: list | None = None) -> Counter:
    """Well-filled containers of ``b`` in ``a``; what they displace makes others fuller by swaps, and best fit places the rest."""
    left, child = Counter(supply), Counter()

    def take(p: Pattern, n: int) -> None:
        n = min(n, *(left[s] // k for s, k in p))
        if n > 0:
            child[p] += n
            for s, k in p:
                left[s] -= n * k

    of_a, of_b = of_a or ranked(a), of_b or ranked(b)
    best = [p for _, p in of_b[: max(1, len(of_b) // 2)]]
    for p in [p for p in best if rng.random() < 0.5] or best[:1]:
        take(p, b[p])
    # the emptier containers give their items up as well, and so do some of the others
    drop = rng.choice((0.02, 0.1, 0.3))
    for full, p in of_a:
        if full == cap or rng.random() < 0.5:
            n = a[p]
            if n <= 4:
                take(p, sum(rng.random() >= drop for _ in range(n)))
            else:
                take(p, int(n * (1 - drop) + rng.random()))
    child, left = improved_counts(child, +left, cap, rng)
    order = sorted(left, reverse=True) if rng.random() < 0.5 else _blurred(left, rng)
    return filled_counts(left, cap, child, order, rng) if rng.random() < 0.25 else best_fit_counts(left, cap, child, order)


def evolve_counts(supply: Counter, cap: int, start: list[Counter], seed: int) -> Counter:
    """The best packing one island finds from the packings it is given and its own."""
    rng = random.Random(seed)
    least = -(-sum(s * n for s, n in supply.items()) // cap)
    known = lambda p: (fitness(p, cap), p, ranked(p))
    people = sorted(map(known, [*start, best_fit_counts(supply, cap, Counter())]), key=lambda x: x[0])
    while people[0][0][0] > least and len(people) < POPULATION:
        order = _blurred(supply, rng)
        people.append(known(filled_counts(supply, cap, Counter(), order, rng) if len(people) % 2 else best_fit_counts(supply, cap, Counter(), order)))
        people.sort(key=lambda x: x[0])
    idle = 0
    while people[0][0][0] > least and idle < PATIENCE:
        (_, a, of_a), (_, b, of_b) = rng.sample(people, 2)
        child = known(crossover_counts(a, b, supply, cap, rng, of_a, of_b))
        idle = 0 if child[0][0] < people[0][0][0] else idle + 1
        if child[0] < people[-1][0] and all(child[1] != p for _, p, _ in people):
            people[-1] = child
            people.sort(key=lambda x: x[0])
    return people[0][1]


def _counted(bins: list[Bin], sizes: list[int]) -> Counter:
    return Counter(tuple(sorted(Counter(sizes[i] for i in items if sizes[i]).items(), reverse=True)) for _, items in bins)


def _dealt(people: Counter, sizes: list[int]) -> list[Bin]:
    """The items of each size, dealt to the containers of a packing; those without a size go to the first."""
    there: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        there.setdefault(s, []).append(i)
    out = [[there[s].pop() for s, k in p for _ in range(k)] for p, n in people.items() for _ in range(n)]
    if there.get(0):
        out = out or [[]]
        out[0] += there[0]
    return [(sum(sizes[i] for i in h), tuple(h)) for h in out]


def crossover(a: list[Bin], b: list[Bin], sizes: list[int], cap: int, rng: random.Random) -> list[Bin]:
    """``crossover_counts`` for single items."""
    return _dealt(crossover_counts(_counted(a, sizes), _counted(b, sizes), Counter(s for s in sizes if s), cap, rng), sizes)


def evolve(sizes: list[int], cap: int, start: list[list[Bin]], seed: int) -> list[Bin]:
    """``evolve_counts`` for single items."""
    return _dealt(evolve_counts(Counter(s for s in sizes if s), cap, [_counted(x, sizes) for x in start], seed), sizes)


_PATTERN = pa.list_(pa.struct([("size", pa.int64()), ("k", pa.int64())]))
_SCHEMA = "target string, cap bigint, island int, origin int, pattern array<struct<size:bigint,k:bigint>>, n bigint"
_NAMES = ["target", "cap", "island", "origin", "pattern", "n"]
_TYPES = [S, L, I, I, _PATTERN, L]


def _epoch(t: pa.Table) -> pa.Table:
    """One island's epoch for one target; ``origin`` tells the packings it is given apart (-1: the items alone)."""
    r = t.to_pydict()
    cap, island = r["cap"][0], r["island"][0]
    given: dict[int, Counter] = {}
    for o, p, n in zip(r["origin"], r["pattern"], r["n"]):
        given.setdefault(o, Counter())[tuple((x["size"], x["k"]) for x in p)] += n
    supply: Counter = Counter()
    for p, n in next(iter(given.values())).items():
        for s, k in p:
            supply[s] += n * k
    start = [g for o, g in sorted(given.items()) if o >= 0]
    seed = island + ISLANDS * sum(g.total() for g in start)
    best = evolve_counts(supply, cap, start, seed + 7919 * r["epoch"][0])
    out = [(r["target"][0], cap, island, island, [{"size": s, "k": k} for s, k in p], n) for p, n in sorted(best.items())]
    return pa.Table.from_batches([batch(out, _NAMES, _TYPES)])


def _evolved(items: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(target, pattern, n) of the best island of each target, and the containers of each; ``items`` has target, cap, size and n."""
    one = F.array(F.struct("size", F.lit(1).cast("long").alias("k")))
    now = items.select("target", "cap", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), F.lit(-1).alias("origin"), one.alias("pattern"), "n")
    least = {r.target: -(-r.tokens // r.cap) for r in items.groupBy("target", "cap").agg(F.sum(F.col("size") * F.col("n")).alias("tokens")).collect()}
    bins: dict[str, int] = {}
    epoch = idle = 0
    while True:
        # a number of partitions that is named is kept, so that the islands run side by side though their rows are few
        now = now.withColumn("epoch", F.lit(epoch)).repartition(max(1, ISLANDS * len(least)), "target", "island")
        now = materialise(now.groupBy("target", "island").applyInArrow(_epoch, _SCHEMA))
        # one row for each target and island, which are bounded
        got = now.groupBy("target", "island").agg(F.sum("n").alias("bins"), F.sum(F.col("n") * F.pow(F.expr("aggregate(pattern, 0L, (a, x) -> a + x.size * x.k)") / F.col("cap"), 2)).alias("square")).collect()
        best = {}
        for r in sorted(got, key=lambda r: (r.bins, -r.square, r.island)):
            best.setdefault(r.target, r)
        found = {t: r.bins for t, r in best.items()}
        idle = 0 if not bins or any(found[t] < bins[t] for t in found) else idle + 1
        bins, epoch = found, epoch + 1
        if idle >= STALLED or all(bins[t] <= least[t] for t in bins):
            break
        # each island keeps its elite and gets that of the one before it
        now = now.withColumn("island", F.explode(F.array("island", ((F.col("island") + 1) % ISLANDS).cast("int"))))
    chosen = items.sparkSession.createDataFrame([(t, r.island) for t, r in best.items()], "target string, island int")
    return now.join(F.broadcast(chosen), ["target", "island"], "left_semi").select("target", "pattern", "n"), bins


def _placed(rest: DataFrame, packing: DataFrame, parts: int) -> DataFrame:
    """``rest`` with ``bin``: the items of each target and size, numbered, meet the places its packing has for that size."""
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    # patterns and places are bounded by the capacity
    p = packing.withColumn("before", zero(F.sum("n").over(earlier(Window.partitionBy("target").orderBy("pattern")))))
    p = p.select("target", "n", "before", F.inline("pattern"))
    p = p.withColumn("start", zero(F.sum(F.col("n") * F.col("k")).over(earlier(Window.partitionBy("target", "size").orderBy("before")))))
    p = p.withColumn("stop", F.col("start") + F.col("n") * F.col("k"))
    p = p.withColumn("block", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(stop - 1) div {BLOCK}"))))
    # a size that most items have is numbered in many tasks
    r = rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    n = r.groupBy("target", "size", "part").agg(F.count("*").alias("m"))
    n = n.withColumn("offset", zero(F.sum("m").over(earlier(Window.partitionBy("target", "size").orderBy("part"))))).drop("m")
    r = r.withColumn("nth", F.row_number().over(Window.partitionBy("target", "size", "part").orderBy("doc_id", "piece")) - 1)
    r = r.join(n, ["target", "size", "part"]).withColumn("rank", F.col("offset") + F.col("nth")).withColumn("block", F.expr(f"rank div {BLOCK}"))
    both = r.join(p, ["target", "size", "block"]).where("rank >= start AND rank < stop")
    return both.select("target", "cap", "doc_id", "piece", "size", F.expr("before + (rank - start) div k").alias("bin"))


def pack(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(target, container, doc_id, piece, first_token, tokens): the container of each text or piece.

    Pieces of a text count from 0; ``first_token`` is where a piece begins.
    ``container`` is unique within its target.
    """
    found = targets.select("target", "capacity_tokens").distinct().toLocalIterator()
    out, counts = docs.sparkSession.createDataFrame([], "target string, container string, doc_id bigint, piece int, first_token bigint, tokens bigint"), None
    while todo := list(itertools.islice(found, MAX_TARGETS)):
        counts = counts or materialise(token_counts(docs, path).distinct())
        out = out.unionByName(_packed(counts, todo))
    return out


def _packed(counts: DataFrame, todo: list) -> DataFrame:
    """``pack`` of the texts in ``counts`` (doc_id, tokens) for a block of targets."""
    n = counts.count()
    caps = F.array(*[F.struct(F.lit(t.target).alias("target"), F.lit(t.capacity_tokens).cast("long").alias("cap")) for t in todo])
    every = counts.select("doc_id", "tokens", F.explode(caps).alias("c")).select("c.target", "c.cap", "doc_id", "tokens")
    whole = every.withColumn("full", F.floor(F.col("tokens") / F.col("cap")))
    # a text of exactly one capacity is no split; a longer one fills containers and leaves a rest
    filled = whole.where("full >= 1").select("target", "cap", "doc_id", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"))
    filled = filled.select("target", F.concat(F.lit("full-"), "doc_id", F.lit("-"), "piece").alias("container"), "doc_id", "piece", (F.col("piece") * F.col("cap")).alias("first_token"), F.col("cap").alias("tokens"))
    rest = whole.select("target", "cap", "doc_id", F.col("full").cast("int").alias("piece"), (F.col("tokens") - F.col("full") * F.col("cap")).alias("size"), "full").where("size > 0 OR full = 0").drop("full")
    some = rest.where("size > 0")
    packing, bins = _evolved(materialise(some.groupBy("target", "cap", "size").agg(F.count("*").alias("n"))))
    packed = _placed(some, packing, max(1, n * len(todo) // PART))
    # empty texts take no room, so they are spread over what is there
    most = F.array_max(F.array(F.lit(1), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for t in todo for x in (t.target, bins.get(t.target, 1))]), F.col("target")), F.lit(1))))
    empty = rest.where("size = 0").withColumn("bin", F.pmod(F.xxhash64("doc_id"), most))
    named = packed.unionByName(empty).withColumn("container", F.concat(F.lit("mixed-"), "bin"))
    return filled.unionByName(named.select("target", "container", "doc_id", "piece", (F.col("piece") * F.col("cap")).alias("first_token"), F.col("size").alias("tokens")))


def fill(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, capacity_tokens, containers, tokens, fill) of each target."""
    t = packed.groupBy("target").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return targets.select("target", "capacity_tokens").distinct().join(t, "target", "left").select(
        "target", "capacity_tokens", F.coalesce("containers", F.lit(0)).alias("containers"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("fill"))


def compared(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, capacity_tokens, containers, best_fit, bound) of each target: the containers used, those that plain
    best fit, largest first, would use, and the number no packing can do without."""
    t = targets.select("target", "capacity_tokens").distinct()
    p = materialise(packed.select("target", "container", "tokens"))
    used = p.groupBy("target").agg(F.countDistinct("container").alias("containers"), F.count_if(F.col("container").startswith("full-")).alias("full"))
    rest = p.where("container LIKE 'mixed-%' AND tokens > 0").groupBy("target", "tokens").agg(F.count("*").alias("n")).join(t, "target")

    def plain(x: pa.Table) -> pa.Table:
        r = x.to_pydict()
        supply, cap = Counter(dict(zip(r["tokens"], r["n"]))), r["capacity_tokens"][0]
        bound = -(-sum(s * n for s, n in supply.items()) // cap)
        return pa.Table.from_pydict({"target": r["target"][:1], "fits": [best_fit_counts(supply, cap, Counter()).total()], "least": [bound]}, pa.schema([("target", S), ("fits", L), ("least", L)]))

    # one row for each size, so a group is bounded by the capacity
    other = rest.groupBy("target").applyInArrow(plain, "target string, fits bigint, least bigint")
    z = lambda c: F.coalesce(c, F.lit(0))
    both = t.join(used, "target", "left").join(other, "target", "left")
    return both.select("target", "capacity_tokens", z("containers").alias("containers"), (z("full") + z("fits")).alias("best_fit"), (z("full") + z("least")).alias("bound"))
