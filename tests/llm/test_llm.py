"""Training-data operators: small cases, odd inputs, and brute force over the smallest tables."""

import os
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.llm import leaks, lookalikes, near, packing, pieces, queries as q, scans, truncation
from paperloom.session import table

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
WORD = re.compile("[a-z0-9]+")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# 1 scans


def test_misread_words_are_found_by_anagram():
    assert scans.anagram("c0vcr") - scans.anagram("cover") == scans.anagram("0c") - scans.anagram("oe")
    assert scans.one_change("cerarnic", "ceramic")[0] >= 0 and scans.one_change("muler", "muffler")[0] >= 0 and scans.one_change("abc", "abd") == (-1, -1)


def test_corrections_are_ranked(spark):
    w = spark.createDataFrame([("ceramic", 50), ("cerarnic", 2), ("be", 90), ("he", 95), ("lone", 3), ("x", 1), ("", 9), (None, 4), ("rotor", 40), ("r0tor", 9)], "word string, n bigint")
    assert rows(scans.corrections(w).select("word", "correct")) == [("cerarnic", "ceramic")]
    assert scans.corrections(w.limit(0)).count() == 0


def scanned(spark):
    body = "The rotor of the pump is greased and the casing is closed at once by the fitter.\n" * 6
    page = "The rotor of the long pump is greased and the cas-\ning is closed by the r0tor of the read-\n\nAcme Works issue 3\nPump manual - 4\n\nout valve in over-\nand under-voltage of the pump.\nAcme Works issue 3\n5  Pump manual\nThe rotor is closed and greased by the fitter with care."
    numbers = "Readings of the pump:\n12\n14\n\nAcme Works issue 3\nPump manual - 6"
    heads = [("d", 0, "heading", "Pump manual"), ("d", 1, "paragraph", page), ("d", 2, "paragraph", numbers), ("d", 3, "paragraph", None), ("d", 4, "paragraph", ""), ("d", 1, "paragraph", page)]
    known = [("k", i, "paragraph", body + " a read-out valve, a read-out unit") for i in range(3)]
    s = spark.createDataFrame([(*x, "extra") for x in heads + known], "doc_id string, seq int, type string, content string, text string")
    r = spark.createDataFrame([("e", None), ("f", ""), ("g", "x" * 200_000)], "doc_id string, markdown string")
    return s, r


@pytest.mark.parametrize("spread", [5000, 1])
def test_noisy_lines(spark, monkeypatch, spread):
    monkeypatch.setattr(scans, "SPREAD", spread)
    s, r = scanned(spark)
    got = rows(scans.findings(s, r).select("doc_id", "seq", "line_no", "kind").distinct())
    assert got == [("d", 1, 0, "hyphen"), ("d", 1, 1, "compound"), ("d", 1, 1, "misread"), ("d", 1, 3, "running_head"), ("d", 1, 4, "running_head"), ("d", 1, 8, "running_head"), ("d", 1, 9, "running_head"), ("d", 2, 4, "running_head"), ("d", 2, 5, "running_head")]
    assert scans.findings(s.limit(0), r.limit(0)).count() == 0


def test_repaired_text(spark):
    s, r = scanned(spark)
    text = {x.seq: x.repaired for x in scans.repaired(s, r).collect() if x.doc_id == "d"}
    assert text[1] == "The rotor of the long pump is greased and the casing is closed by the rotor of the read-out valve in over- and under-voltage of the pump. The rotor is closed and greased by the fitter with care."


def test_lines_of_any_width_and_long_words_count(spark):
    long = "rotorgehäuse" * 6
    wide = "The rotor of the long pump is greased and the casing is closed by the fitter of the works at once and then again, " * 3
    narrow = "the pump is\ngreased at\nonce by a"
    rows_ = [("n", 1, "paragraph", narrow), ("w", 1, "paragraph", f"{wide}\n{wide}\n{long.replace('rotor', 'r0tor', 1)} is"), *[("k", i, "paragraph", f"{long} {long}") for i in range(8)]]
    s = spark.createDataFrame(rows_, "doc_id string, seq int, type string, content string")
    r = spark.createDataFrame([], "doc_id string, markdown string")
    assert rows(scans.findings(s, r).select("doc_id", "seq", "line_no", "kind")) == [("w", 1, 2, "misread")]
    assert {x.doc_id for x in scans.repaired(s, r).collect()} == {"n", "w"}
    assert scans.is_wrapped(scans.prose_lines(narrow, "paragraph")) and not scans.is_wrapped(scans.prose_lines("- one two three\n- four five six", "paragraph"))
    assert scans._near("a" * 500 + "bc", "a" * 500 + "cb", 2) and not scans._near("abcdef", "badcfe", 2) and scans._near("", "ab", 2)


def test_known_words_are_bounded_before_they_reach_the_driver(spark, monkeypatch):
    long = "rotorgehäuse" * 6
    s, r = scanned(spark)
    more = [("d", 5, "paragraph", f"The fitter of the works writes\nthat the {long.replace('rotor', 'r0tor', 1)} is closed."), *[("k", 10 + i, "paragraph", f"{long} {long}") for i in range(8)]]
    s = s.select("doc_id", "seq", "type", "content").unionByName(spark.createDataFrame(more, "doc_id string, seq int, type string, content string")).repartition(4)
    sent, known, frame, scan = [], [], type(s), scans._scan
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: sent.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    monkeypatch.setattr(scans, "_scan", lambda every, heads, words: known.append(words) or scan(every, heads, words))
    results = []
    for most in (50_000, 3, 0):
        monkeypatch.setattr(scans, "KNOWN", most)
        found = scans.findings(s, r).select("doc_id", "seq", "line_no", "kind", "wrong", "correct").distinct()
        assert len(sent) == len(known) and not any("TakeOrdered" in p for p in sent)
        results.append(sorted(tuple(map(str, x)) for x in collect(found)))
    assert "rotor" in known[0] and long not in known[0] and max(map(len, known[0])) <= scans.LONGEST
    assert [len(k) for k in known[1:]] == [3, 0] and results[0] == results[1] == results[2]
    assert ("d", "5", "1", "misread", long.replace("rotor", "r0tor", 1), long) in results[0]


def test_wrapped_text_without_noise_is_joined(spark):
    s, r = scanned(spark)
    more = [("d", 7, "paragraph", "At the test bay the fitter writes\na report on the annular winding."), ("d", 8, "code", "  x = 1\n\n\n\n  y = 2"), ("d", 9, "table", "| a | b |\n| - | - |\n| c | d |"), ("no scan", 1, "paragraph", "one line")]
    s = s.select("doc_id", "seq", "type", "content").unionByName(spark.createDataFrame(more, "doc_id string, seq int, type string, content string"))
    text = {(x.doc_id, x.seq): x.repaired for x in scans.repaired(s, r).collect()}
    assert text["d", 7] == "At the test bay the fitter writes a report on the annular winding."
    assert not {("d", 8), ("d", 9), ("no scan", 1)} & set(text)
    kept = "A paragraph.\n\n```\nx\n\n\n\ny\n```\n\n| a |\n| - |\n\n# Heading"
    assert scans.repair(kept, "markdown", []) == kept


# 2 pieces


def test_pieces_fit_and_rebuild_the_text():
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["word ", "end. ", "\n\n", "\n", "# h\n", "字。", "x" * 30, "```\n"]) for _ in range(rng.randrange(0, 90)))
        limit = rng.randrange(5, 60)
        overlap = rng.randrange(0, limit)
        got = pieces.cuts(len(t), pieces.boundaries(t)[0], limit, overlap)
        whole = t[: got[0][1]]
        for (a, b, _), (c, d, _) in zip(got, got[1:]):
            assert c == b - overlap and b - a <= limit and d > b
            whole += t[b:d]
        assert whole == t and got[-1][1] - got[-1][0] <= limit
    with pytest.raises(ValueError):
        pieces.cuts(10, pieces.boundaries("abc")[0], 5, 5)


def test_cut_prefers_headings(spark):
    t = "one two. three\n\n# Head\n\nfour five six seven"
    at, _ = pieces.boundaries(t)
    assert pieces.cuts(len(t), at, 30, 0)[0][2] == "heading" and t[pieces.cuts(len(t), at, 30, 0)[0][1] :].startswith("# Head")
    d = spark.createDataFrame([("a", None), ("b", ""), ("c", "y" * 50), ("c", "y" * 50), ("e", "w. " * 20)], "doc_id string, markdown string")
    p = spark.createDataFrame([("p", 20, 5), ("p", 20, 5)], "profile string, max_chars int, overlap_chars int")
    assert rows(pieces.oversized(d, p)) == [("p", "c", "forced"), ("p", "c", "oversized"), ("p", "e", "oversized")]
    assert pieces.oversized(d, p.limit(0)).count() == 0 and pieces.split(d.limit(0), p).count() == 0
    assert all(len(r.piece_text) <= 20 for r in pieces.split(d, p).collect())


def test_forced_cuts_are_those_of_long_stretches():
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice(["a", "bc", " ", ".", "x" * rng.randrange(1, 25), "\n", "   ", "字"]) for _ in range(rng.randrange(0, 40)))
        limit = rng.randrange(2, 20)
        at, breaks = pieces.boundaries(t)
        got = pieces.cuts(len(t), at, limit, rng.randrange(0, limit))
        assert pieces.forced(got, breaks, len(t), limit) == (len(t) > limit and max(map(len, re.findall(r"[^\s.!?。！？]+", t)), default=0) > limit)


def test_profiles_in_blocks_give_the_same(spark, monkeypatch):
    d = spark.createDataFrame([("c", "y" * 50), ("e", "w. " * 20), ("e", "w. " * 20), ("f", None)], "doc_id string, markdown string")
    p = spark.createDataFrame([(f"p{i}", 10 + i, i % 5) for i in range(7)], "profile string, max_chars int, overlap_chars int")
    want = rows(pieces.oversized(d, p)), rows(pieces.split(d, p))
    monkeypatch.setattr(pieces, "MAX_PROFILES", 2)
    assert (rows(pieces.oversized(d, p)), rows(pieces.split(d, p))) == want and want[0]


@needs_data
def test_oversized_brute(spark):
    d, prof = table(spark, DATA, "conversion_results"), [tuple(r) for r in table(spark, DATA, "chunk_profiles").collect()]
    want = set()
    for r in d.where("markdown IS NOT NULL").collect():
        run = max(map(len, re.findall(r"[^\s.!?。！？]+", r.markdown)), default=0)
        want |= {(p, r.doc_id, k) for p, m, _ in prof if len(r.markdown) > m for k in ("oversized", "forced") if k == "oversized" or run > m}
    assert rows(q.p2_found(spark, DATA)) == sorted(want)


# 3 look-alikes


def _letters_with_marks():
    return [c for c in map(chr, range(0x80, 0x2FFFF)) if not 0xAC00 <= ord(c) <= 0xD7A3 and unicodedata.normalize("NFD", c) != c and c in lookalikes._BASES]


def test_every_canonical_pair_is_one_class(spark):
    letters = _letters_with_marks()
    assert len(letters) > 1500 and {"ḍ", "ṁ", "ď", "й", "ガ"} <= set(letters)
    pairs = [(f"{i}x {c}y", f"{i}x {unicodedata.normalize('NFD', c)}y") for i, c in enumerate(letters)] + [(f"{c}y", f"{unicodedata.normalize('NFD', c)}y") for c in "가각힣"]
    v = spark.createDataFrame([(x,) for p in pairs for x in p], "value string")
    form = {r.value: r.canonical for r in lookalikes.classes(v).collect()}
    assert [p for p in pairs if form[p[0]] != form[p[1]]] == []
    assert len(set(form.values())) == len(pairs)


def test_signs_that_are_spelt_out_lie_in_the_blocks_that_are_looked_at():
    assert all(re.match("[Ͱ-ԯἀ-῿Ⅰ-Ⅻﬀ-ﬆ]", c) for c in {**lookalikes._APART, **lookalikes._JOINED})


def test_widths_and_mathematical_letters(spark):
    same = [("カタカナ", "ｶﾀｶﾅ"), ("ガード", "ｶﾞｰﾄﾞ"), ("Rotor A1", "𝐑𝐨𝐭𝐨𝐫 𝐀𝟏"), ("ℋ and ℝ", "H and R"), ("Ｗｉｄｅ　ｂｌａｎｋ", "Wide blank"), ("x" + " " * 400 + "y", "x y"), ("ｑ̣" + "̣" * 0, "q̣")]
    apart = [("m²", "m2"), ("カ", "ガ"), ("①", "1"), ("Ａ", "a"), ("ä", "a")]
    v = spark.createDataFrame([(x,) for p in same + apart for x in p], "value string")
    form = {r.value: r.canonical for r in lookalikes.classes(v).collect()}
    assert [p for p in same if form[p[0]] != form[p[1]]] == [] and [p for p in apart if form[p[0]] == form[p[1]]] == []


def test_alike_references_are_all_linked(spark):
    refs = spark.createDataFrame([(1, "Prüf mal", "x"), (2, "Pru\u0308f mal", "y"), (3, None, None), (4, "", None)], "ref_id bigint, content string, doc_id string")
    s = spark.createDataFrame([("a", 0, "Prüf mal"), ("a", 1, "Pru\u0308f mal"), ("b", 0, "Prüf\u00a0mal"), ("b", 0, "Prüf\u00a0mal"), ("c", 0, "Pruf mal"), ("d", 0, None), ("e", 0, "\u200b"), ("f", 0, "P\u200b" * 3000)], "doc_id string, seq int, content string")
    assert rows(lookalikes.same_as(s, refs)) == [(1, "a", 1), (1, "b", 0), (2, "a", 0), (2, "b", 0), (4, "e", 0)]
    assert lookalikes.same_as(s, refs.limit(0)).count() == 0 and lookalikes.same_as(s.limit(0), refs).count() == 0


def test_classes(spark):
    v = spark.createDataFrame([("file",), ("ﬁle",), ("f​ile",), ("ｆｉｌｅ",), ("File",), ("Prüf",), ("Prüf",), ("Pruf",), ("m²",), ("m2",), ("а b",), ("a b",), (None,), ("",), ("",), ("x" * 100_000,)], "value string")
    got = defaultdict(set)
    for r in lookalikes.classes(v).collect():
        got[r.canonical].add(r.value)
    sets = sorted(map(len, got.values()))
    assert sets == [1, 1, 1, 1, 1, 1, 2, 2, 4] and any(x == {"а b", "a b"} for x in got.values())
    assert {r.value: r.canonical for r in lookalikes.classes(v, spark.createDataFrame([("ﬁle",)], "value string")).collect()}["file"] == "ﬁle"


@needs_data
def test_references_brute(spark):
    f = lambda x: re.sub(" +", " ", unicodedata.normalize("NFC", x.translate(lookalikes.PY_MAP))).strip()
    refs = {f(r.content): (r.ref_id, r.content) for r in table(spark, DATA, "ref_texts").collect()}
    want = {(refs[f(r.content)][0], r.doc_id, r.seq) for r in table(spark, DATA, "sections").where("content IS NOT NULL").collect() if f(r.content) in refs and refs[f(r.content)][1] != r.content}
    assert rows(q.p3_found(spark, DATA)) == sorted(want) and want
    s = table(spark, DATA, "sections")
    assert lookalikes.same_as(s.limit(0), table(spark, DATA, "ref_texts")).count() == 0
    assert lookalikes.same_as(s, table(spark, DATA, "ref_texts").limit(0)).count() == 0


# 5 near-duplicates


def test_odd_sketch_estimates_high_similarity():
    a, b = near._seeds(near.K)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(900)]
    for changes in (10, 40, 90):
        other = base[:]
        for i in rng.sample(range(900), changes):
            other[i] = "z" + str(i)
        x, y = near.shingles(" ".join(base), 3), near.shingles(" ".join(other), 3)
        true = len(set(x) & set(y)) / len(set(x) | set(y))
        assert abs(near.estimate(near.odd_sketch(near.minhash(x, a, b)), near.odd_sketch(near.minhash(y, a, b))) - true) < near.slack(true)


@needs_data
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_near_pairs_brute(spark, folder):
    sets = defaultdict(list)
    for r in table(spark, folder, "conversion_results").where("markdown IS NOT NULL").select("doc_id", "markdown").distinct().collect():
        w = WORD.findall(r.markdown.lower())
        sets[r.doc_id].append({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    ids = sorted(sets)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] for x in sets[a] for y in sets[b] if x and y and len(x & y) >= 0.6 * len(x | y)}
    assert rows(q.p5_found(spark, folder)) == sorted(want)


def test_near_odd_inputs(spark):
    t = " ".join(f"w{i}" for i in range(60))
    x = spark.createDataFrame([("a", t, 1), ("b", t.upper() + "!", 2), ("b", t, 3), ("c", t + " more", 4), ("d", None, 5), ("e", "", 6), ("f", "one two", 7), ("g", "q " * 100_000, 8), ("h", " ".join(f"v{i}" for i in range(60)), 9)], "id string, text string, rep int")
    members, pairs = near.links(x)
    assert rows(near.id_pairs(members, pairs)) == [("a", "b"), ("a", "c"), ("b", "c")]
    g = {r.id: (r.class_id, r.links) for r in near.groups(members, pairs).collect()}
    assert g == {"a": ("a", 1), "b": ("a", 1), "c": ("a", 1), "g": ("g", 0), "h": ("h", 0)}
    m, p = near.links(x.limit(0))
    assert near.groups(m, p).count() == 0 and near.id_pairs(m, p).count() == 0


def test_long_chains_are_one_group(spark):
    members = spark.createDataFrame([(f"n{i:03d}", i, f"n{i:03d}") for i in range(300)], "id string, set_hash bigint, rep string")
    pairs = spark.createDataFrame([(i, i + 1, 0.9) for i in range(299)], "a bigint, b bigint, similarity double")
    assert {r.class_id for r in near.groups(members, pairs).collect()} == {"n000"}


def test_hot_bands_lose_no_pair(spark, monkeypatch):
    rng = random.Random(8)
    template = [f"t{i}" for i in range(60)]
    texts = []
    for k in range(60):
        w = list(template)
        for _ in range(rng.choice([1, 2, 6, 12])):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append((f"n{k:02d}", " ".join(w)))
    sets = {i: {tuple(x.split()[j : j + 3]) for j in range(len(x.split()) - 2)} for i, x in texts}
    want = [(a, b) for a in sorted(sets) for b in sorted(sets) if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])]
    d = spark.createDataFrame([(*x, 1) for x in texts], "id string, text string, n int")
    for hot in (1000, 3):
        monkeypatch.setattr(near, "HOT", hot)
        m, p = near.links(d, 3, 0.6)
        assert rows(near.id_pairs(m, p)) == want and 20 < len(want) < 60 * 59 / 2


def test_runs_of_bands_give_all_pairs(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    for hot in (2, 5, 100):
        monkeypatch.setattr(near, "HOT", hot)
        for _ in range(60):
            rows_ = sorted({(rng.randrange(-6, 6), rng.randrange(40)) for _ in range(rng.randrange(0, 60))})
            got, at = [], 0
            while at < len(rows_):
                part = rows_[at : at + rng.randrange(1, 40)]
                at += len(part)
                cut = [part[i : i + 7] for i in range(0, len(part), 7)]
                made = near._band_runs(pa.RecordBatch.from_pydict({"key": [k for k, _ in c], "id": [i for _, i in c]}, pa.schema([("key", pa.int64()), ("id", pa.int64())])) for c in cut)
                got += [tuple(r.values()) for b in made for r in b.to_pylist()]
            edges = defaultdict(list)
            for kind, key, a, _ in got:
                if kind == near._EDGE:
                    edges[key].append(a)
            hots = {key for kind, key, _, _ in got if kind == near._HOT} | {k for k, v in edges.items() if len(v) > hot}
            pairs = [(a, b) for kind, _, a, b in got if kind == near._PAIR] + [(a, b) for k, v in edges.items() if k not in hots for a in v for b in v if a < b]
            members = defaultdict(list)
            for k, i in rows_:
                members[k].append(i)
            assert hots == {k for k, v in members.items() if len(v) > hot}
            assert sorted(pairs) == sorted((a, b) for k, v in members.items() if k not in hots for a in v for b in v if a < b)


def test_many_equal_texts_give_no_pairs(spark):
    d = spark.range(10_000).select(F.col("id").cast("string").alias("id"), F.lit("one text that is in the table very many times").alias("text"))
    m, p = near.links(d)
    assert p.count() == 0
    g = near.groups(m, p)
    assert g.count() == 10_000 and g.select("class_id", "links").distinct().collect() == [("0", 0)]


def test_scheme_keeps_to_its_bounds():
    for t in (0.5, 0.6, 0.7, 0.8, 0.9):
        k, r = near.scheme(t)
        assert k <= near.K and k % r == 0 and (1 - t**r) ** (k // r) <= near.MISSED


# 6 packing


def test_best_fit_and_crossover_lose_nothing():
    rng = random.Random(3)
    sizes = [rng.randrange(0, 300) for _ in range(120)]
    a, b = (packing.best_fit(rng.sample(range(120), 120), sizes, 512, []) for _ in range(2))
    for bins in (a, b, packing.crossover(a, b, sizes, 512, rng), packing.evolve(sizes, 512, [a], 1)):
        assert sorted(i for _, items in bins for i in items) == list(range(120)) and all(used == sum(sizes[i] for i in items) <= 512 for used, items in bins)
    assert len(packing.evolve(sizes, 512, [a, b], 1)) <= min(len(a), len(b))


def test_packing_whole(spark):
    docs = spark.createDataFrame([(i, "word " * (7 * i % 90), "x") for i in range(60)] + [(100, None, None), (101, "", None), (102, "long " * 400, None)], "doc_id bigint, text string, target string")
    t = spark.createDataFrame([("small", 64), ("big", 1024)], "target string, capacity_tokens int")
    got = packing.pack(docs, t).collect()
    cap, full, seen = {"small": 64, "big": 1024}, defaultdict(int), defaultdict(int)
    for r in got:
        full[r.target, r.container] += r.tokens
        seen[r.target, r.doc_id] += r.tokens
    tokens = {r.doc_id: r.tokens for r in packing.token_counts(docs).collect()}
    assert all(v <= cap[k[0]] for k, v in full.items()) and dict(seen) == {(g, d): n for g in cap for d, n in tokens.items()} and 100 not in tokens
    assert len({(r.target, r.doc_id, r.piece) for r in got}) == len(got)
    assert all(sum(x.target == g and x.doc_id == d for x in got) == max(1, -(-tokens[d] // cap[g])) for g in cap for d in tokens)
    assert packing.pack(docs.limit(0), t).count() == 0 and packing.pack(docs, t.limit(0)).count() == 0


def test_packing_is_no_worse_than_best_fit_over_all(spark):
    rng = random.Random(9)
    n = {i: rng.choice([rng.randint(1, 63), rng.randint(1, 200)]) for i in range(1500)}
    docs = spark.createDataFrame([(i, "word " * k) for i, k in n.items()], "doc_id bigint, text string")
    t = spark.createDataFrame([("small", 64), ("big", 300)], "target string, capacity_tokens int")
    sizes = {r.doc_id: r.tokens for r in packing.token_counts(docs).collect()}
    got = {r.target: r.containers for r in packing.fill(packing.pack(docs, t), t).collect()}
    for target, cap in (("small", 64), ("big", 300)):
        rest = sorted((s % cap for s in sizes.values() if s % cap), reverse=True)
        plain = packing.best_fit(list(range(len(rest))), rest, cap, [])
        assert packing.best_fit_counts(packing.Counter(rest), cap, packing.Counter()).total() == len(plain)
        assert got[target] <= sum(s // cap for s in sizes.values()) + len(plain)


def test_evolution_beats_best_fit():
    rng = random.Random(1)
    cases = [(Counter({4: 100, 3: 200}), 10)]
    cases += [(Counter(rng.randrange(15, 60) for _ in range(600)), 100) for _ in range(4)]
    triples = Counter()
    for _ in range(60):
        a = rng.randrange(380, 490)
        b = rng.randrange(250, (1000 - a) // 2 + 1)
        triples.update([a, b, 1000 - a - b])
    for supply, cap in [*cases, (triples, 1000)]:
        plain, best = packing.best_fit_counts(supply, cap, Counter()), packing.evolve_counts(supply, cap, [], 3)
        least = -(-sum(s * n for s, n in supply.items()) // cap)
        assert least <= best.total() < plain.total()
        held = Counter()
        for p, n in best.items():
            assert packing.held(p) <= cap
            for s, k in p:
                held[s] += n * k
        assert held == supply


def test_swaps_keep_all_items():
    rng = random.Random(6)
    for _ in range(100):
        supply = Counter(rng.randrange(1, 40) for _ in range(rng.randrange(1, 60)))
        bins = packing.best_fit_counts(Counter({s: n // 2 for s, n in supply.items() if n > 1}), 60, Counter())
        inside = Counter()
        for p, n in bins.items():
            for s, k in p:
                inside[s] += n * k
        out, left = packing.improved_counts(bins, supply - inside, 60)
        after = Counter(left)
        for p, n in out.items():
            assert packing.held(p) <= 60
            for s, k in p:
                after[s] += n * k
        assert after == supply and out.total() == bins.total()


@needs_data
def test_targets_in_blocks_give_the_same(spark, monkeypatch):
    d, t = table(spark, DATA, "documents"), table(spark, DATA, "pack_targets")
    want = rows(packing.fill(packing.pack(d, t), t))
    monkeypatch.setattr(packing, "MAX_TARGETS", 1)
    assert rows(packing.fill(packing.pack(d, t), t)) == want and want[0][2]
    assert packing.pack(d, t.limit(0)).count() == 0


def test_compared(spark):
    sizes = [4] * 10 + [3] * 20 + [25, 0]
    counts = [(i, "t", f"mixed-{i % 12}" if n < 25 else "full-x", 0, 0, n) for i, n in enumerate(sizes)]
    p = spark.createDataFrame(counts, "doc_id bigint, target string, container string, piece int, first_token bigint, tokens bigint")
    t = spark.createDataFrame([("t", 10), ("u", 5)], "target string, capacity_tokens int")
    assert rows(packing.compared(p, t)) == [("t", 10, 13, 13, 11), ("u", 5, 0, 0, 0)]


# 7 leaks


def brute_leaks(docs, items, n=13):
    out = set()
    for i, t in items:
        w = WORD.findall((t or "").lower())
        k = min(n, len(w))
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
        for d, x in docs:
            v = WORD.findall((x or "").lower())
            if any(tuple(v[j : j + k]) in grams for j in range(len(v) - k + 1)):
                out.add((i, d))
    return sorted(out)


def test_leaks_random(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 6, 9]))) for i in range(25)] + [(90, None), (91, ""), (92, "?!")]
    docs = [(i, text(rng.randrange(0, 30)).replace(" ", rng.choice([" ", "-", "\n"])).upper()) for i in range(60)] + [(90, None), (91, ""), (92, "A B C D " * 20_000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("x"))
    want = brute_leaks(docs, items, 6)
    assert rows(leaks.leaks(d, i, 6)) == want and rows(leaks._joined(d, i, 6)) == want and want
    assert leaks.leaks(d, i.limit(0)).count() == 0 and leaks.leaks(d.limit(0), i).count() == 0


def test_spans_are_cut_out(spark):
    item = " ".join(f"k{i}" for i in range(15))
    d = spark.createDataFrame([(1, "Before. " + item.upper() + "! After it."), (2, "clean text"), (3, None), (4, item), (5, "İ " * 30 + item)], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {r.doc_id: (r.text, r.removed, r.kept) for r in leaks.without_leaks(d, i).collect()}
    assert got[1][0] == "Before.  ! After it." and got[1][1] == 15 and got[2] == ("clean text", 0, True) and got[3] == (None, 0, True) and got[4][2] is False
    assert "k1" not in got[5][0] and got[5][0].startswith("İ ")


def test_large_item_sets_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    words = list("abcdefg")
    docs = [(k, rng.choice(["", "", "É. "]) + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for k in range(60)] + [(60, None), (61, ""), (62, "a " * 20_000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 9])))) for k in range(25)] + [(25, None)]
    d = spark.createDataFrame([(*x, "clash") for x in docs + docs[:3]], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    want = rows(leaks.leaks(d, i, 5)), rows(leaks.without_leaks(d, i, 5))
    assert want[0]
    for name, bound in (("MAX_ITEMS", 1), ("MAX_CHARS", 1), ("MAX_GRAMS", 1)):
        with monkeypatch.context() as m:
            m.setattr(leaks, name, bound)
            m.setattr(leaks, "HOT", 3)
            assert leaks._grams(i, 5) is None
            assert (rows(leaks.leaks(d, i, 5)), rows(leaks.without_leaks(d, i, 5))) == want
            if name == "MAX_ITEMS":
                assert leaks.leaks(d.limit(0), i, 5).count() == 0 and leaks.without_leaks(d, i.limit(0), 5).count() == len(docs) + 3


@needs_data
def test_leaks_brute(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, DATA, "eval_items").collect()]
    assert rows(q.p7_found(spark, DATA)) == brute_leaks(docs, items)


# 8 truncation


def test_ends():
    done = ["It ends.", "- an entry\n\n* * *", "| a | b |\n| - | - |\n| 1 | 2 |", "```\nx\n```", '"Quoted."  \n', "Text, etc.", "他说完了。", "## Annex (left blank)", "", "   "]
    cut = ["A sentence that stops in the", "One. Two begins and", "```\ncode", "| a | b |\n| - | - |\n| 1 |", "Text with [...]", "It was so…", "measured at 60.", "中文没有完"]
    assert [truncation.tail(t)[0] for t in done] == ["done"] * len(done)
    assert all(truncation.tail(t)[0] in ("cut", "open") for t in cut)


def test_order_finds_strict_prefixes(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 7))) for _ in range(200)] + [None, "é", "éa"]
    v = spark.createDataFrame([(x,) for x in values], "value string").repartition(7)
    have = {x for x in values if x is not None}
    assert sorted(r.value for r in truncation.strict_prefixes(v).collect()) == sorted(a for a in have if any(b != a and b.startswith(a) for b in have))


def test_longer_copies_show_cuts(spark):
    text = "## Stationary condenser list of the works\n\n" + "The condenser is cleaned and the pump is greased by the fitter. " * 3 + "\n\n- first entry of it\n- second entry of it\n- third"
    d = spark.createDataFrame([(1, text + " entry of it", "s"), (2, text[:-2], "s"), (3, text[:-2] + "…", None), (4, text + " entry of it", "t"), (5, None, "s"), (6, "", None)], "doc_id bigint, text string, source string")
    assert {r.doc_id for r in truncation.prefix_copies(d).where("rest <> ''").collect()} == {2, 3}
    got = rows(truncation.truncated(d).select("doc_id"))
    assert got == [(2,), (3,)]
    rate = {r.source: (r.documents, r.truncated) for r in truncation.rates(d, truncation.truncated(d)).collect()}
    assert rate == {"s": (3, 1), None: (2, 1), "t": (1, 0)}
    assert truncation.truncated(d.limit(0)).count() == 0


def test_evidence_is_named(spark):
    whole = "- the fitter closes the casing of the pump and then the valve of it"
    sentences = "The winding is greased by the fitter.\nThe winding is closed.\nA long line of the list without any stop that goes on and on " + "and on " * 40
    texts = [
        whole, whole[:-10], sentences + "\n- the winding is gre", sentences + "\nThe winding is greased by the fitter. The winding is", sentences + "\n\nA long line of the list without any stop",
        sentences + "\n\nThe winding is cl", sentences + "\n\n| a | b |\n| - | - |\n| 1 |", sentences,
    ]
    docs = spark.createDataFrame([(i, "s", t, "clash") for i, t in enumerate(texts)] + [(1, "s", texts[1], "again")], "doc_id bigint, source string, text string, evidence string")
    got = {r.doc_id: r.evidence for r in truncation.evidence(docs).collect()}
    assert got[1] == "copy" and got[2] == "word" and got[3] == "lead" and got[4] == "line" and got[5] in ("lead", "word") and got[6] == "rule"
    assert len(truncation.prefix_hashes("abcde")) == 4 and truncation.prefix_hashes("abcd")[:3] == truncation.prefix_hashes("abcde")[:3]
    assert truncation.evidence(docs.limit(0)).count() == 0


def test_copies_cut_between_words_or_early_show(spark):
    long = "- the fitter greases the pump\n- the fitter closes the casing of the pump and then the valve of it"
    texts = [long, long[: long.index(" and then")], "## Stationary condenser list", "## Stationary condenser list of works [...]", "## Works\n\nText.", "## Works", "## Valve.", "## Valve. More"]
    # the last lines are complete lines here, so only the copies decide
    texts.append("The pump list Works works it More and so on.\n- the fitter closes the casing of the pump\n## Stationary condenser list\n## Works\nEnd.")
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")
    rest = {r.doc_id: r.rest for r in truncation.prefix_copies(docs).collect()}
    assert rest == {1: " and then the valve of it", 2: " of works", 5: "\n\nText.", 6: " More"}
    got = {r.doc_id for r in truncation.truncated(docs).collect()}
    assert {1, 2} <= got and not {5, 6} & got
