"""Operators over whole tables, and the pipeline, against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.llm import components, decontamination, mixing, near_dups, quality_rules, secret_scan, substring_dedup
from meshlark.llm.shared import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, kept boolean, cid long, times int, h long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, True, 1, 1, 1) for i, t, s in rows], SCHEMA)


def vocabulary(r, n=4000):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(n)]


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def families(seed, hub=400):
    """A hot family of copies of one text with random edits, chains of copies of copies, truncated copies, and unrelated texts."""
    r = random.Random(seed)
    v = vocabulary(r)
    base = [r.choice(v) for _ in range(120)]

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[r.randrange(len(w))] = r.choice(v)
        return w

    texts = [base] + [edited(base, r.randrange(0, 6)) for _ in range(hub)] + [base[: r.randrange(85, 120)] for _ in range(60)] + [edited(base[: r.randrange(95, 120)], r.randrange(0, 3)) for _ in range(60)]
    for _ in range(12):
        chain = [r.choice(v) for _ in range(150)]
        for _ in range(6):
            chain = edited(chain, 2)
            texts.append(chain)
    texts += [[r.choice(v) for _ in range(r.randrange(1, 80))] for _ in range(150)]
    out = [" ".join(w) for w in texts]
    out += [None, "", " \n", "A b", "a B", "x", out[3].upper(), out[3], "é à " * 200]
    ids = list(range(1000, 1000 + len(out)))
    r.shuffle(ids)
    return list(zip(ids, out, strict=True))


def grouped(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and min(len(x), len(y)) * 100 >= 85 * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= 85 * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i, _ in rows}, {i: len(s) for i, s in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = families(seed)
    want, n = grouped(rows)
    df = table(spark, [(i, t, "s") for i, t in rows] + [(*rows[5], "s"), (None, rows[0][1], "s")])
    got = near_dups.near_duplicates(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id == want[rows[0][0]] and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (n[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = near_dups.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted([-1, *{i for i in want if want[i] == i}])


def test_pipeline_links_at_four_fifths(spark):
    import corpus_pipeline

    r = random.Random(14)
    v = vocabulary(r)
    rows, want = [], set()
    for k in range(20):
        w = [r.choice(v) for _ in range(104)]
        for i, n in enumerate((0, 10, 12)):  # 100 shingles: similarities of 0.82 and 0.79 to the first
            rows.append((10 * k + i, " ".join(w[: 104 - n] + [f"{i}.{x}" for x in range(n)]), "s"))
        want |= {10 * k, 10 * k + 2}
    df = table(spark, rows)
    assert {x.doc_id for x in corpus_pipeline.near_copies(spark, df, "").collect()} == want
    assert near_dups.deduplicated(df).count() == len(rows)

    rows = families(4)
    sets = [(i, shingles(t)) for i, t in rows]
    at = {i: i for i, _ in rows}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if at[a] != at[b] and len(x & y) * 100 >= 80 * len(x | y) > 0:
            low, high = sorted((at[a], at[b]))
            at = {i: low if c == high else c for i, c in at.items()}
    got = near_dups.near_duplicates(table(spark, [(i, t, "s") for i, t in rows]), whole=80).collect()
    assert {x.doc_id: x.component_id for x in got} == at


def test_many_unlike_copies_take_few_rounds(spark, monkeypatch):
    r = random.Random(21)
    v = vocabulary(r)
    base = [r.choice(v) for _ in range(150)]
    family = []
    for k in range(60):  # of one text, nearly all too far from each other to be linked
        w = list(family[k - 1] if k % 10 == 9 else base)
        for _ in range(2 if k % 10 == 9 else 10):
            w[r.randrange(len(w))] = r.choice(v)
        family.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(family)] + [(1000 + i, f"{i} alone") for i in range(2500)]
    sets = {i: shingles(t) for i, t in rows[:60]}
    want = {}
    for k in range(9, 60, 10):
        assert len(sets[k - 1] & sets[k]) * 100 >= 80 * len(sets[k - 1] | sets[k])
        want |= {k - 1: k - 1, k: k - 1}
    assert sum(len(x & y) * 100 >= 80 * len(x | y) for x, y in itertools.combinations(sets.values(), 2)) == len(want) // 2
    docs = table(spark, [(i, t, "s") for i, t in rows])
    bands = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda b: F.when(F.col("doc_id") < 60, -b).otherwise(F.col("doc_id") * 25 + b).cast("long"))
    classes = docs.select(F.col("doc_id").alias("cid"), F.xxhash64("text").alias("th"), F.size(F.split("text", " ")).cast("long").alias("n"), bands.alias("bands"))
    rounds, one = [], near_dups._with_components
    monkeypatch.setattr(near_dups, "_with_components", lambda *a: rounds.append(1) or one(*a))
    assert {x.id: x.component for x in near_dups.links(classes, docs, "doc_id", "text", 80).collect()} == want
    assert len(rounds) <= 3


def test_links_beyond_a_few_hundred_thousand_are_joined_in_one_task(spark):
    n = 250_000  # a path of 150,000 nodes in mixed order, and stars
    order = np.random.default_rng(5).permutation(150_000)
    ends = [(order[:-1], order[1:]), (200_000 + np.arange(n - 149_999), 200_000 + np.arange(n - 149_999) // 10 * 10 + 9)]
    u, v = (np.concatenate([x[k] for x in ends]) for k in (0, 1))
    rows = components.components(spark.createDataFrame(list(zip(u.tolist(), v.tolist(), strict=True)), "a long, b long"))
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
    got = {x.id: x.component for x in rows.collect()}
    assert all(got[k] == (0 if k < 200_000 else k // 10 * 10) for k in got) and len(got) > 240_000


def test_near_duplicates_without_links(spark):
    assert near_dups.near_duplicates(table(spark, [(1, None, "s")]).limit(0)).count() == 0
    got = near_dups.near_duplicates(table(spark, [(1, "a b c d e f", "s"), (2, "g h i", "s")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1, True), (2, 1, 2, True)]


def test_superminhash():
    r = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        a = r.integers(0, 1 << 63, 200, dtype=np.uint64)
        shared = int(r.integers(50, 200))
        b = np.concatenate((a[:shared], r.integers(0, 1 << 63, 200 - shared, dtype=np.uint64)))
        s = near_dups.superminhash(np.concatenate((np.sort(a), np.sort(b))), np.array([0, 200, 400]))
        errors.append((s[0] == s[1]).mean() - shared / (400 - shared))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05
    s = near_dups.superminhash(a[:9], np.array([0, 3, 3, 9]))
    whole = near_dups.superminhash(a[:3], np.array([0, 3]))
    assert (s[0] == whole[0]).all() and (s[1] == np.iinfo(np.uint64).max).all() and (whole >> np.uint64(40)).max() < near_dups.SLOTS
    # signatures of parts are merged by their least values
    halves = near_dups.superminhash(a[:9], np.array([0, 4, 9]))
    assert (np.minimum(halves[0], halves[1]) == near_dups.superminhash(a[:9], np.array([0, 9]))[0]).all()


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(500, 560)] + [(900, k) for k in range(901, 980)] + [(7, 7)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    table = spark.createDataFrame(links, "a long, b long")
    for few in (components.FEW, 0):  # in one task, and by rounds
        rows = components.components(table, few).collect()
        got = {x.id: x.component for x in rows}
        assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in links)} and len(got) == len(rows)
    assert components.components(table.limit(0)).count() == 0


def test_word_hashes_tell_words_apart():
    r = random.Random(6)
    v = sorted({*vocabulary(r, 3000), "é", "e", "ab", "ba", "a", "aa"})
    texts = [" ".join(v), "\n".join(reversed(v)), "", "a"]
    h, start, end, first, _ = words([t.encode() for t in texts])
    assert len(set(h[: len(v)].tolist())) == len(v) and (h[: len(v)] == h[len(v) : 2 * len(v)][::-1]).all() and np.diff(first).tolist() == [len(v), len(v), 0, 1]


def test_regular_words_are_told_apart(spark):
    thue_morse = lambda n: "".join("ab"[k.bit_count() & 1] for k in range(n))
    turned = str.maketrans("ab", "ba")
    v = [w for n in (8, 16, 128, 129, 1024, 2048, 4096, 8192) for w in (thue_morse(n), thue_morse(n).translate(turned))]
    assert len(set(words([w.encode() for w in v])[0].tolist())) == len(v)
    got = near_dups.near_duplicates(table(spark, [(k, w, "s") for k, w in enumerate(v)])).collect()
    assert all(x.component_id == x.doc_id and x.n_shingles == 1 for x in got)
    (x,) = quality_rules.quality_report(spark.createDataFrame([(1, "en", "s", f"a b {v[8]} c d a b {v[9]} c d")], "doc_id long, lang string, source string, text string")).collect()
    assert x.n_repeat_words == 0


def test_repeated_passages(spark):
    r = random.Random(8)
    v = vocabulary(r)
    prose = lambda n: " ".join(r.choice(v) for _ in range(n))
    passages = [prose(60) for _ in range(12)]
    line = prose(25)
    rows = []
    for k in range(120):
        p = passages[k % 12] if k < 60 else ""
        rows.append((k, f"{prose(70)} é {p} {prose(r.randrange(30, 70))}\n{line}\n{prose(9)}", "s"))
    rows += [(200, None, "s"), (201, "", "s"), (202, rows[100][1], "s"), (203, "same line again and again\n" * 30, "s"), (204, "x" * 30_000, "s"), (None, rows[0][1], "s"), rows[7]]
    df = table(spark, rows)
    got = substring_dedup.repeats(df).collect()
    texts = {i: t for i, t, _ in rows if i is not None}
    assert {x.doc_id for x in got} == {*range(60), 100, 202} and {x.doc_id for x in got if not x.kept} == {*range(12, 60), 202}  # a line of 25 words is no passage
    assert {x.doc_id for x in got if x.kept} >= {*range(12), 100}
    for x in got:
        part = texts[x.doc_id][x.start : x.stop]
        assert x.n_words >= substring_dedup.LEAST_WORDS and (x.kept_in == x.doc_id if x.kept else x.kept_in < x.doc_id) and part in texts[x.kept_in]
    whole = [x for x in got if x.doc_id == 202]
    assert [(x.start, x.stop, x.kept_in, x.n_words) for x in whole] == [(0, len(texts[100]), 100, len(texts[100].split()))]
    cut = {x.doc_id: x.text for x in substring_dedup.cut_out(df).collect()}
    assert cut[202] == "" and cut[100] == texts[100] and cut[200] is None and len(cut[30]) < len(texts[30])
    assert substring_dedup.repeats(df.limit(0)).count() == 0


def test_passages_against_all_pairs(spark, monkeypatch):
    r = random.Random(16)
    v = vocabulary(r, 300)
    gap = lambda: r.choice([" "] * 30 + ["\n", "  "])
    pool = [[r.choice(few) + gap() for _ in range(300)] for few in (v[:2], v[:5], v, v, v, ["a", "no"])]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(r.randrange(0, 4)):
            a, src = r.randrange(250), r.choice(pool)
            w += src[a : a + r.randrange(5, 120)] + [r.choice(v) + gap() for _ in range(r.randrange(0, 30))]
        texts.append("".join(w))
    df = table(spark, [(k, t, "s") for k, t in enumerate(texts)])
    got = substring_dedup.repeats(df).collect()
    n = substring_dedup.PASSAGE
    held, places = {}, []
    for k, t in enumerate(texts):
        at = [m.span() for m in WORD.finditer(t)]
        for i in range(len(at) - n + 1):
            a, b = at[i][0], at[i + n - 1][1]
            held.setdefault(t[a:b], set()).add(k)
            places.append((k, a, b, t[a:b]))
    shared = [p for p in places if len(held[p[3]]) > 1]
    assert len(shared) > 300
    for k, a, b, part in shared:  # every repeated passage meets a span, and is cut out of all documents but one
        meets = [x for x in got if x.doc_id == k and x.start < b and x.stop > a]
        assert any(not x.kept for x in meets) if k > min(held[part]) else meets
    for x in got:  # and a span's parts are held by other documents, earlier ones unless it is kept; parts that meet may be of two
        part, others = texts[x.doc_id][x.start : x.stop], [t for k, t in enumerate(texts) if (k != x.doc_id if x.kept else k < x.doc_id)]
        assert np.mean([any(part[i : i + 9] in t for t in others) for i in range(0, len(part) - 8, 7)]) > 0.7
    # hot digests take the way of the broadcast table
    monkeypatch.setattr(substring_dedup, "HOT", 10**9)
    monkeypatch.setattr(substring_dedup, "max", lambda a, b: 1, raising=False)
    assert sorted(map(tuple, substring_dedup.repeats(df).collect())) == sorted(map(tuple, got))


def test_chunks_rejoin_and_resist_shifts():
    r = random.Random(9)
    texts = ["", "é🎉ß" * 3000, "a", " ".join(vocabulary(r, 900)), "", "zz" * 400, "日本" * 5000]
    enc = [t.encode() for t in texts]
    of = lambda x: substring_dedup.chunks(substring_dedup.Texts(x))
    text, place, word, one, two = of(enc)
    for k, t in enumerate(texts):
        m = text == k
        assert "".join(t[p >> 32 : p & 0xFFFFFFFF] for p in place[m]) == t
        assert [w & 0xFFFFFFFF for w in word[m]][-1:] == ([len(t.split())] if t else [])
        if t:
            alone = of([enc[k]])
            assert (alone[3] == one[m]).all() and (alone[4] == two[m]).all()
    assert np.isin(one[text == 3], of([("inserted " + texts[3]).encode()])[3]).mean() > 0.97
    for run in (b"0", b"7", b"z", b"ab"):
        assert len(of([run * 100_000])[0]) <= 60


def test_passages_of_few_words_are_found(spark):
    r = random.Random(12)
    v = vocabulary(r)
    prose = lambda n: " ".join(r.choice(v) for _ in range(n))
    of = lambda few: " ".join(r.choice(few) for _ in range(51))
    passages = [" ".join([w] * 51) for w in ("the", "0", "ok", "é", "na-na", "x" * 40)] + [" ".join((x * 51)[:51]) for x in (["a", "b"], ["no", "yes", "no"], ["1", "2", "3"])]
    passages += [of([str(k) for k in range(10)]) for _ in range(200)] + [of(v[:2]) for _ in range(100)] + [of("ab") for _ in range(50)] + [prose(51) for _ in range(150)]
    rows, at = [], {}
    for k, p in enumerate(passages):
        rows.append((k, f"{prose(20)} {p} {prose(20)}", "s"))
        before = prose(9)
        rows.append((1000 + k, f"{before} {p} {prose(9)}", "s"))
        at[1000 + k] = len(before) + 1, len(before) + 1 + len(p)
    got = {}
    for x in substring_dedup.repeats(table(spark, rows)).collect():
        got.setdefault(x.doc_id, []).append((x.start, x.stop))
    missed = [passages[i - 1000] for i, (a, b) in at.items() if not any(start < b and stop > a for start, stop in got.get(i, []))]
    assert not missed


def test_a_run_of_one_word_gives_few_rows():
    of = lambda x: substring_dedup.grams(substring_dedup.Texts(x))
    text, place, _, one, two = of([b"", b"word " * 20_000, b"no", b""])
    assert len(set(one)) == len(set(two)) == 1 and set(text) == {1} and len(text) < 1200 and ((place & 0xFFFFFFFF) - (place >> 32) >= 64).all()
    assert all(len(x) == 0 for x in of([b"", b"a b"]))


def test_leaks(spark):
    r = random.Random(10)
    v = vocabulary(r)
    prose = lambda n: " ".join(r.choice(v) for _ in range(n))
    items = [(k, prose(r.randrange(15, 50))) for k in range(30)] + [(90, None), (91, "?!"), (92, "qz7"), (93, prose(300))]

    def spoiled(t, share):
        t = list(t)
        for _ in range(int(share * len(decontamination.plain(t_ := "".join(t).encode())))):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice([[], ["q"], [t[k], "x"]])
        return "".join(t) if t_ else ""

    rows, want = [], set()
    for k in range(200):
        t = prose(r.randrange(5, 60))
        if k % 3 == 0:
            i, p = items[r.randrange(30)]
            t = f"{t}. {spoiled(p, 0.05 * (k % 2)).upper() if k % 5 else p} {prose(9)}"
            want.add((k, i))
        rows.append((k, t, "s"))
    rows += [(300, None, "s"), (301, "", "s"), (302, "a QZ-7!", "s"), (303, "pre " * 9000 + items[33][1], "s"), rows[0]]
    want |= {(302, 92), (303, 93)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = table(spark, rows)
    got = decontamination.leaks(df, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want) + 1
    in_blocks = decontamination.leaks(df, bench, block_bytes=700).collect()
    assert sorted(map(tuple, in_blocks)) == sorted(map(tuple, got))
    blocked = decontamination.clean(df.withColumn("_op_matches", F.lit(3)), bench, block_bytes=2000)
    assert blocked.columns == [*df.columns, "_op_matches"] and {x.doc_id for x in blocked.collect()} == {i for i, _, _ in rows} - {d for d, _ in want}
    clean = decontamination.clean(df, bench)
    assert clean.columns == df.columns and {x.doc_id for x in clean.collect()} == {i for i, _, _ in rows} - {d for d, _ in want}
    assert decontamination.leaks(df.limit(0), bench).count() == 0 and decontamination.leaks(df, bench.limit(0)).count() == 0


def test_very_long_and_repetitive_texts_leak():
    import tracemalloc

    long = np.random.default_rng(3).integers(97, 123, 17_000_000, dtype=np.uint8).tobytes()
    assert decontamination.Passages([(1, b"qwertyui")]).search([long[:90], long.replace(b"qwertyui", b"") + b"qwertyui"]) == [[], [(1, 0, 8)]]
    items = [(1, b"a" * 160), (2, b"ab" * 70), (3, b"zz"), (4, b"b" * 7)]
    tracemalloc.start()
    found = decontamination.Passages(items).search([b"a" * 300_000, b"ab" * 300, b"a" * 150 + b"c" * 9 + b"b" * 9, b"", b"zz"])
    assert found == [[(1, 0, 160)], [(2, 0, 140)], [(1, 10, 160), (4, 0, 7)], [], [(3, 0, 2)]] and tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_parts_of_items_leak():
    r = random.Random(15)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)).encode()
    for size in (119, 150, 191, 240, 326, 700):
        item = letters(size)
        search = decontamination.Passages([(1, item)]).search
        for at in {0, (size - 119) // 2, size - 119}:
            part = item[at : at + 119]
            assert search([letters(90) + part + letters(90)]) == [[(1, 0, 80 if size > 119 else 119)]]
        assert search([letters(90) + item + letters(90)]) == [[(1, 0, min(size, 160))]] and search([letters(900)]) == [[]]
    item = letters(120)  # edits in the middle of an item that no shorter piece may have
    assert decontamination.Passages([(1, item)]).search([item[:54] + item[66:]]) == [[(1, 12, 120)]]


def test_banded_alignment_is_edit_distance():
    r = random.Random(11)

    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != d)))
            row = new
        return min(row)

    for _ in range(200):
        p, t = (bytes(r.choice(b"abc") for _ in range(r.randrange(1, 12))) for _ in range(2))
        e = plain(p, t)
        assert decontamination.edits(p, t, 20) == e and decontamination.edits(p, t, 1) == min(e, 2)


def test_mix(spark):
    r = random.Random(12)
    rows = [(k, "w " * r.randrange(0, 40), r.choice(["b", "a", "c", None, "c", "c", "c"])) for k in range(2000)] + [(5000, None, "a"), (5001, "", None)]
    df = table(spark, rows + [rows[3]])
    report = mixing.mix_report(df).collect()
    assert len(report) == len(rows) + 1
    sizes = {}
    for _, t, s in rows + [rows[3]]:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    goal = mixing.targets(sizes)
    assert abs(sum(goal.values()) - 1.5 * sum(sizes.values())) < 1e-6 and all(goal[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    source = {k: s for k, _, s in rows}
    got = dict.fromkeys(sizes, 0)
    for x in report:
        assert (x.source_size, x.target) == (sizes[source[x.doc_id]], goal[source[x.doc_id]]) and 0 <= x.taken <= 2 * x.size
        got[source[x.doc_id]] += x.taken
    assert all(abs(got[s] - goal[s]) <= 80 for s in sizes)
    assert sorted(map(str, mixing.mix_report(df.repartition(7)).collect())) == sorted(map(str, report))
    assert mixing.mix_report(df.limit(0)).count() == 0
    out = mixing.taken(df)
    assert out.columns == [*(c for c in df.columns if c != "times"), "times"] and out.where("times = 0").count() == 0
    assert out.agg(F.sum(mixing.word_count(F.col("text")) * F.col("times"))).first()[0] == sum(got.values())


def test_targets_by_hand():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 200.0, "b": pytest.approx(250 * 2 / 3), "c": pytest.approx(250 / 3)}
    assert mixing.targets({"b": 0, None: 10}) == {"b": 0.0, None: 15.0} and mixing.targets({}) == {}


def test_flow_is_largest_and_repeats_least():
    r = random.Random(13)
    for _ in range(200):
        names = "abcd"[: r.randrange(1, 5)]
        patterns = {tuple(sorted(r.sample(names, r.randrange(1, len(names) + 1)))): r.randrange(0, 30) for _ in range(r.randrange(1, 7))}
        quotas = {s: r.randrange(0, 60) for s in names}
        flow = mixing.routed(patterns, quotas, 2)

        def most(times):
            """The largest flow, as the least cut."""
            cuts = (c for k in range(len(names) + 1) for c in itertools.combinations(names, k))
            return min(sum(quotas[s] for s in c) + sum(times * n for p, n in patterns.items() if not set(p) <= set(c)) for c in cuts)

        total = sum(sum(f.values()) for f in flow.values())
        again = sum(max(0, sum(flow[p].values()) - n) for p, n in patterns.items())
        assert total == most(2) and total - again == most(1)
        assert all(sum(f.get(s, 0) for f in flow.values()) <= quotas[s] for s in names) and all(sum(flow[p].values()) <= 2 * n for p, n in patterns.items())


def test_overlapping_sources(spark):
    rows = [(k, "w " * 10, k) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k long")
    members = F.when(F.col("k") < 30, F.array(F.lit("a"))).when(F.col("k") < 60, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    mix, sizes, goal = mixing.mixed(df, sources=members, share=1.0)
    assert sizes == {"a": 600, "b": 600}
    total = mix.agg(F.sum(F.col("size") * F.col("times"))).first()[0]
    assert abs(total - 900) <= 20 and abs(sum(goal.values()) - 900) < 1e-6 and mix.where("times > 2").count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(14)
    v = vocabulary(r)
    prose = lambda n: " ".join(r.choice(v) for _ in range(n))
    leak = prose(40)
    rows = [(k, prose(80), "en", f"s{k % 3}") for k in range(90)]
    rows += [(100, rows[4][1], "en", "s0"), (101, prose(50) + " " + leak, "en", "s1"), (102, prose(40) + ' token = "f3ef4d6b2755a36d7d9c25bd72c4d5f6" ' + prose(40), "en", "s2"), (103, "too short", "en", "s0"), (104, "same words in each of the lines here " * 30, "en", "s1"), (105, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "secret scans", "mixing"]
    stage, seen = docs, []
    for _, f in corpus_pipeline.STAGES:
        stage = f(spark, stage, str(tmp_path))
        seen.append({x.doc_id for x in stage.collect()})
    every = {x[0] for x in rows}
    assert seen[0] == every - {103, 104, 105} and seen[1] == seen[0] - {100} and seen[2] == seen[1] - {101} and seen[3] == seen[2] and seen[4] <= seen[3]
    out = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == seen[4] and set(next(iter(out.values())).asDict()) == {*docs.columns, "times"}
    if 102 in out:
        assert "f3ef4d" not in out[102].text and out[102].n_chars == len(out[102].text)
    text = {x[0]: x[1] for x in rows}
    assert all(out[k].text == text[k] for k in out if k != 102)
    assert secret_scan.secret_report(corpus_pipeline.run(spark, str(tmp_path))).where("n_hex > 0").count() == 0


def test_pipeline_stages_carry_odd_rows_and_columns(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(18)
    v = vocabulary(r)
    prose = lambda n: " ".join(r.choice(v) for _ in range(n))
    rows = [(k, prose(60), "en", "s0", 0, "x", 1, 2, 3.0) for k in range(30)]
    rows += [rows[3], rows[3], (None, prose(60), None, None, None, None, None, None, None), (50, None, "en", "s0", 0, "x", 1, 2, 3.0), (51, "", None, "s0", 0, "x", 1, 2, 3.0), (52, prose(30_000), "en", None, 0, "x", 1, 2, 3.0)]
    schema = "doc_id long, text string, lang string, source string, _op_kept int, kept string, component_id long, times int, _OP_h double"
    docs = spark.createDataFrame(rows, schema).withColumn("n_chars", F.length("text").cast("long"))
    spark.createDataFrame([(1, None), (2, prose(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table_, texts in ((docs, 32), (docs.limit(0), 0)):
        stage, counts = table_, []
        for name, f in corpus_pipeline.STAGES:
            stage = f(spark, stage, str(tmp_path))
            assert [c for c in stage.columns if c != "times"] == [c for c in docs.columns if c != "times"], name
            counts.append(stage.count())
        assert counts[0] <= texts + 2 and counts[1] == counts[2] == counts[3] and counts[4] <= counts[3]
        if texts:
            kept = [x.doc_id for x in stage.collect()]
            assert counts[0] >= 33 and counts[1] == counts[0] - 2 and len(set(kept)) == len(kept) and kept


def test_registered_queries_have_sql_columns():
    from meshlark.llm import queries

    assert len(queries.queries()) == 10 and set(queries.oracle_sql()) <= set(queries.queries())
