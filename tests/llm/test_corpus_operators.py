"""Operators over whole corpora: brute force on small fixtures, planted cases, edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vedette.llm import decontam, jaccard, lines, urlfilter

URLS = ["http://example.com/en/1", "https://www.example.com/en/", "HTTP://WWW.Example.COM/EN/x", "http://a.b.net/es/?q=/fr/",
        "http://net/fr/x", "http://internet/es/x", "http://x.net#/es/", "http://x.com", "http://x.com/", "no scheme", "", None,
        "://", "a://b://net/es/", "http://sub.example.com/en/z", "http://ex ample.com/en/", "http://x.com\n/en/", "x" * 9_000 + "://q.net/es/"]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best and best[2], best[3] if best else "allow")


def test_word_hashes_and_shingles_of_texts_hashed_together(monkeypatch):
    r = random.Random(11)
    words = ["".join(r.choices("abAB\u00e9\x00", k=r.choice([1, 2, 5, 64, 65, 200]))) for _ in range(400)]
    texts = ["", " ", "one", "a b c d", "A B\tc D\x0be ", *[" ".join(r.choices(words, k=r.randrange(40))) for _ in range(200)],
             " ".join(r.choices(words, k=9_000))]
    for text in texts:  # long texts are hashed in stretches
        h, start = jaccard.word_hashes(text.encode())
        plain = text.encode().lower().split()
        assert len(h) == len(plain) and len(set(zip(h.tolist(), plain))) == len(set(h.tolist())) == len(set(plain))
    monkeypatch.setattr(jaccard, "TOGETHER", 3_000)
    for text, s in zip(texts, jaccard.shingle_sets(texts), strict=True):
        plain = text.encode().lower().split()
        k = max(1, min(5, len(plain)))
        assert len(s) == len({tuple(plain[i:i + k]) for i in range(len(plain) - k + 1)})
        assert s.tolist() == sorted(set(s.tolist())) == jaccard.shingles(text).tolist()


def test_urls_are_judged_as_by_all_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(URLS + URLS[:3])],
                                  "page_id long, url string, verdict string, _hit string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    rows = urlfilter.judge_urls(pages, rules).collect()
    assert len(rows) == len(URLS) + 3
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"], RULES)
    assert {r["verdict"] for r in urlfilter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(4_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("pmod(xxhash64(key), 9) = 0")
    cascade = urlfilter.Cascade(listed, universe.union(universe))
    assert len(cascade.levels) > 1
    wrong = universe.where(cascade.contains(F.col("key")) != (F.expr("pmod(xxhash64(key), 9) = 0"))).count()
    assert wrong == 0
    assert sum(x.words for x in cascade.levels) * 64 < 16 * listed.count()


def corpus(seed, n, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    return rng, [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 150))) for _ in range(n)]


def grouped(texts, k=5, percent=80):
    """(set size, smallest linked place) of each text."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(table))
        return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in inverted[x])
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in s:
            inverted[x].append(i)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed):
    rng, texts = corpus(seed, 40)
    shared = " ".join(f"p{i}" for i in range(25))
    for base in texts[:12]:
        w = base.split()
        for _ in range(rng.randint(1, 12)):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                if v:
                    v[rng.randrange(len(v))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(v))
    texts += [t + " " + shared for t in texts[20:40]]
    rng.shuffle(texts)
    return texts + ["", None, "   ", "one two", "ONE\ttwo", "É é é é é é", "a" * 20_000, "the " * 3_000, texts[0], texts[0]]


@pytest.mark.parametrize("seed,small,medium", [(1, 64, 8_000), (2, 2, 8_000), (3, 2, 3)])
def test_groups_are_brute_force(spark, seed, small, medium):
    texts = near_copies(seed)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)],
                                 "doc_id long, text string, sig string, n long, component_id long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(docs, small=small, medium=medium).collect()}
    assert [got[i] for i in range(len(texts))] == grouped(texts)
    kept = {r["doc_id"] for r in jaccard.one_of_each(docs).collect()}
    assert kept == {c for _, c in got.values()}


@pytest.mark.parametrize("medium", [8_000, 50])
def test_links_between_what_two_pivots_reach(spark, medium):
    running = [f"t{i}" for i in range(60)]
    texts = [" ".join(running[:45]), " ".join(running[9:54])]  # too far from each other
    texts += [" ".join(running[:45] + [f"p{k}"]) for k in range(109)] + [" ".join(running[9:54] + [f"q{k}"]) for k in range(109)]
    texts += [" ".join(running[4:49]), " ".join(running[5:50])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(docs, medium=medium).collect()}
    expected = grouped(texts)
    assert len({g for _, g in expected}) == 1 and grouped(texts[:-1])[1][1] == 1
    assert [got[i] for i in range(len(texts))] == expected


def test_repeated_ids_go_by_their_own_text(spark):
    copy, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, copy), (7, copy), (7, other), (7, other), (8, other + " c"), (None, copy), (9, None)]
    docs = spark.createDataFrame([(i, t, "x", b"y") for i, t in rows], "doc_id long, text string, _gone string, _md5 binary")
    left = sorted((str(r["doc_id"]), r["text"] or "") for r in jaccard.one_of_each(docs).collect())
    assert left == sorted([("1", copy), ("7", other), ("7", other), ("None", copy), ("9", "")])


def test_groups_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (0, "a b c d e f")],
                                 "doc_id long, text string")
    rows = jaccard.near_groups(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in rows if r["n_shingles"]) == [
        (False, 0, 0), (False, 1, 0), (False, 1, 0), (True, 0, 0)]
    assert jaccard.near_groups(docs.limit(0)).count() == 0
    assert jaccard.one_of_each(docs).count() == 3


def test_region_join_is_brute_force():
    for seed in range(5):
        texts = [t for t in near_copies(seed) if t and t.strip()]
        texts = list(dict.fromkeys(texts))
        sets = [jaccard.shingles(t) for t in texts]
        assert jaccard.join_region(sets, 80) == [g for _, g in grouped(texts)]


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        pool = rng.integers(0, 2 ** 63, 2_000).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 1_500))) for _ in range(2))
        assert jaccard.sketch_distance(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_passages_of_fifty_words_are_cut_once(spark):
    rng, texts = corpus(5, 60, words=5_000)
    passages = [" ".join(f"{chr(97 + k)}{rng.randrange(10 ** 6)}" for _ in range(n)) for k, n in enumerate((50, 55, 80, 300))]
    short = " ".join(f"s{i}" for i in range(40))
    rows = []
    for i, t in enumerate(texts):
        w = t.split()
        at = rng.randint(0, len(w))
        extra = passages[i % 4] if i % 3 else short
        rows.append((i, " ".join([*w[:at], extra, *w[at:]])))
    rows += [(100, rows[7][1]), (101, None), (102, ""), (None, passages[0]), (None, passages[0]), (103, "the " * 400),
             (104, passages[2] + "\n\n" + passages[2]), (100, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "x", "x") for i, t in rows], "doc_id long, text string, runs string, _doc string")
    out = defaultdict(list)
    for r in lines.dedup_lines(docs).collect():
        out[r["doc_id"]].append(r)
    assert sum(map(len, out.values())) == len(rows)
    holders = {p: [i for i, t in rows if i is not None and t and p in t] for p in passages}
    for p, ids in holders.items():
        for i in ids:
            assert (p in out[i][0]["text"]) == (i == min(ids))
    for i, t in rows:
        if i is not None and t and short in t and not any(p in t for p in passages):
            assert out[i][0]["text"] == t  # shorter than the least run: left alone
    assert out[100][0]["text"] == "" == out[102][0]["text"] and out[101][0]["text"] is None
    assert all(r["text"] == passages[0] for r in out[None])
    for i, t in rows[:60]:  # nothing but passages goes
        left = t
        for p in passages:
            if p in left and min(holders[p]) != i:
                left = left.replace(p + " ", "").replace(p, "")
        assert out[i][0]["text"].split() == left.split()
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def edited(rng, text, share):
    chars = list(text)
    for i in rng.sample(range(len(chars)), int(share * len(chars))):
        chars[i] = rng.choice(["", "q", chars[i] + "z"])
    return "".join(chars)


def levenshtein_part(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_edit_distance_of_parts_is_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        got = decontam.distance_within(item, text, len(item))
        assert got[0] == levenshtein_part(item, text)


def test_leaks_planted_and_clean(spark):
    rng, texts = corpus(9, 200, words=3_000)
    items = [" ".join(f"{c}{rng.randrange(10 ** 5)}" for c in "abcdefghijklmnopqrstuvwxyz") for _ in range(30)] + ["tiny one"]
    rows, planted = [], set()
    for i, t in enumerate(texts):
        if i < 120:
            k = i % 30
            passage = items[k] if i < 60 else edited(rng, items[k], 0.08)
            t = f"{t[:200]} {passage.upper() if i % 2 else passage} {t[200:]}"
            planted.add((i, k))
        rows.append((i, t))
    rows += [(900, None), (901, ""), (None, items[3]), (902, "x" * 100_000 + "\n" + items[4].replace(" ", "\n  "))]
    planted |= {(902, 4), (None, 3)}
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "  "), (3, items[3])], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.leaks(docs, bench).collect()}
    assert set(found) <= planted and len(found) >= 0.95 * len(planted)
    assert all((i, i % 30) in found and found[i, i % 30] == 0 for i in range(60)) and found[902, 4] == 0
    left = {r["doc_id"] for r in decontam.without_leaks(docs, bench).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in found}
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_thinned_edges_connect_the_same(spark):
    rng = random.Random(8)
    pairs = [(min(p), max(p)) for p in ((rng.randrange(300), rng.randrange(300)) for _ in range(900)) if p[0] != p[1]]
    edges = spark.createDataFrame(pairs + [(900, 901)], "a long, b long").repartition(40)
    thin = jaccard.thinned(edges)
    assert thin.count() < 700
    want = {tuple(r) for r in jaccard.components(edges).collect()}
    assert {tuple(r) for r in jaccard.components(thin).collect()} == want


def test_passages_whose_parts_occur_earlier_on_their_own(spark):
    """The whole passage goes from the later text, whichever earlier texts hold its middle or an end."""
    rng = random.Random(11)

    def words(n):
        return [f"v{rng.randrange(10 ** 9)}" for _ in range(n)]

    rows, want = [], {}
    for k in range(40):
        n = rng.choice((50, 52, 60, 90))
        passage, base = words(n), 10 * k
        for j in range(rng.randint(1, 3)):  # parts with other surroundings, before the whole
            a = rng.choice((0, 11, n - 30))
            rows.append((base + j, " ".join([*words(20), *passage[a:a + 30], *words(20)])))
        rows.append((base + 5, " ".join([*words(20), *passage, *words(20)])))
        rows.append((base + 6, " ".join([*words(20), *passage[11:41], *words(20)])))
        around = words(20), words(20)
        rows.append((base + 7, " ".join([*around[0], *passage, *around[1]])))
        want[base + 7] = around[0] + around[1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"]: r["text"].split() for r in lines.dedup_lines(docs).collect()}
    assert {i: left[i] for i in want} == want
    assert all(left[i] == t.split() for i, t in rows if i not in want)


def test_leaks_take_no_clean_row_of_their_id(spark):
    item = " ".join(f"b{i}{i * 7919}" for i in range(30))
    rows = [(None, f"x {item} y"), (None, "clean one"), (7, f"z {item}"), (7, "clean two"), (7, None), (8, "clean one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = decontam.without_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(str, left)) == sorted(str(r) for r in docs.collect() if item not in (r["text"] or ""))


def test_rows_that_share_an_id_keep_their_own_words(spark):
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"{k}w{rng.randrange(10 ** 6)}" for _ in range(100)) for k in "abc"]
    rows = [(1, f"{texts[0]} {passage}"), (2, f"{texts[1]} {passage}"), (2, " ".join(f"u{i}" for i in range(300))), (2, "two words"),
            (2, None), (3, f"{passage} {texts[2]}"), (3, f"{passage} {texts[2]}")]
    docs = spark.createDataFrame([(i, t, 1, [2], "k") for i, t in rows], "doc_id long, text string, d int, asked array<int>, _own string")
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "runs"]
    got = sorted((r["doc_id"], " ".join((r["text"] or "").split())) for r in out.collect())
    left = [f"{texts[0]} {passage}", texts[1], rows[2][1], "two words", "", texts[2], texts[2]]
    assert got == sorted((i, t) for (i, _), t in zip(rows, left, strict=True))


def earlier_words(texts, length):
    """Per text, the words that stand in a run of ``length`` words which an earlier text or place has as well."""
    seen, out = set(), []
    for words in texts:
        covered = set()
        for i in range(len(words) - length + 1):
            gram = tuple(words[i:i + length])
            if gram in seen:
                covered.update(range(i, i + length))
            seen.add(gram)
        out.append(covered)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_runs_against_all_grams(spark, seed):
    r = random.Random(seed)
    pool = [[f"p{seed}_{k}_{i}" for i in range(r.randint(30, 160))] for k in range(12)]
    texts = []
    for d in range(60):
        words = []
        for _ in range(r.randint(0, 4)):
            words += [f"w{r.randint(0, 400)}" for _ in range(r.randint(0, 90))]
            p = r.choice(pool)
            a = r.randint(0, len(p) // 3)
            words += p[a:r.randint(a, len(p))]
        texts.append(words)
    texts[50] = texts[10] * 2  # repeats another text and itself
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(5)
    found = {row["doc"]: {w for s in row["runs"] for w in range(s["start"], s["end"])} for row in lines.repeated_runs(df).collect()}
    must, may = earlier_words(texts, lines.LEAST), earlier_words(texts, lines.LINE)
    assert sum(map(len, must)) > 1000
    for i in range(len(texts)):
        assert must[i] <= found.get(i, set()) <= may[i]


def test_links_of_texts_together_are_those_of_each():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "b", "c d", "é"], n)) for n in (0, 5, 29, 30, 31, 400, 1, 90)]
    parts = [lines.word_hashes(t) for t in texts]
    of, *together = lines._links(parts, lines.LINE, lines.WINDOW)
    for i, part in enumerate(parts):
        grams = [tuple(part[k:k + lines.LINE]) for k in range(len(part) - lines.LINE + 1)]
        alone = lines._links([part], lines.LINE, lines.WINDOW)[1:]
        assert all((x[of == i] == y).all() for x, y in zip(together, alone, strict=True))
        assert (len(alone[0]) > 0) <= (len(grams) > lines.WINDOW)


def test_shared_beginnings_over_batches_are_brute_force():
    rng = np.random.default_rng(6)
    rows = sorted((int(h), d, at) for h, d, at in rng.integers(0, 4, (60, 3)))
    lists = {}
    for h, d, at in rows:  # hashes stand for all that lies before them
        words = [h, *rng.integers(0, 2, int(rng.integers(0, 4)))]
        lists.setdefault((h, d, at), [hash(tuple(map(int, words[:k + 1]))) if k else h for k in range(len(words))])
    want = [next((k for k, x in enumerate(lists[r]) if not any(x in lists[e] for e in lists if e[0] == r[0] and e < r)), len(lists[r])) for r in rows]
    for size in (1, 2, 3, 7, 60):
        batches = [pa.RecordBatch.from_pydict(
            {"d": pa.array([r[1] for r in part]), "side": pa.array([1] * len(part), pa.int32()), "at": pa.array([r[2] for r in part], pa.int32()),
             "beyond": pa.array([lists[r] for r in part], pa.list_(pa.int64())), "h": pa.array([r[0] for r in part])})
            for part in (rows[k:k + size] for k in range(0, len(rows), size))]
        assert [m for b in lines._furthest(batches) for m in b["more"].to_pylist()] == want


def test_marks_do_not_depend_on_batches():
    rng = np.random.default_rng(7)
    rows = sorted((int(d), int(s), int(s) + 12, int(k), bool(f)) for d, s, k, f in zip(
        rng.integers(0, 4, 80), rng.integers(0, 150, 80), rng.integers(0, 99, 80), rng.integers(0, 4, 80) > 0, strict=True))
    whole = pa.RecordBatch.from_pydict(
        {"doc": pa.array([r[0] for r in rows]), "key": pa.array([r[3] for r in rows]), "start": pa.array([r[1] for r in rows], pa.int32()),
         "end": pa.array([r[2] for r in rows], pa.int32()), "first_text": pa.array([0] * 80, pa.int64()),
         "later": pa.array([r[4] for r in rows]), "offset": pa.array([r[3] % 2 for r in rows], pa.int32())})
    want = pa.Table.from_batches(lines._mark(20)([whole])).to_pylist()
    for size in (1, 7, 33):
        parts = [whole.slice(k, size) for k in range(0, 80, size)]
        assert pa.Table.from_batches(lines._mark(20)(parts)).to_pylist() == want
    chain, reached, n = {}, {}, {}
    for r in want:
        if r["chain"]:
            d = r["doc"]
            n[d] = n.get(d, 0) + (r["start"] > reached.get(d, -1))
            reached[d] = max(reached.get(d, -1), r["end"])
            assert r["chain"] == n[d]
            chain.setdefault((d, n[d]), []).append(r)
    for part in chain.values():
        assert {(r["first"], r["last"]) for r in part} == {(min(r["start"] for r in part), max(r["end"] for r in part))}


def test_links_that_occur_again_over_any_batches():
    rng = random.Random(8)
    for _ in range(200):
        rows = sorted((rng.choice([-5, 0, 1, 2, 3, 9]) if rng.random() < .6 else rng.randrange(100), rng.randrange(4), rng.randrange(3)) for _ in range(rng.randrange(40)))
        first = {}
        for k, d, s in rows:
            first.setdefault(k, (d, s))
        times = Counter(k for k, _, _ in rows)
        want = [(d, k, s, s + 10, first[k][0] + 7, (d, s) != first[k], first[k][1] - s) for k, d, s in rows if times[k] > 1]
        batches, at = [], 0
        while at < len(rows):
            some = rows[at:at + rng.randrange(4)]
            at += len(some)
            key, doc, start = (pa.array([r[c] for r in some], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int32())))
            end, text = (pa.array([r[c] + n for r in some], t) for c, n, t in ((2, 10, pa.int32()), (1, 7, pa.int64())))
            batches.append(pa.RecordBatch.from_arrays([doc, key, start, end, text], ["doc", "key", "start", "end", "text"]))
        assert [tuple(r.values()) for b in lines._again(batches) for r in b.to_pylist()] == want


def test_texts_move_packed(spark):
    texts = ["", "é漢😀", None, "a b " * 5_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    packed = docs.select("doc_id", lines._packed("text").alias("p")).orderBy("doc_id").toArrow()["p"].combine_chunks()
    assert lines._unpacked(packed).to_pylist() == texts and len(packed[3].as_py()) < 1_000
    assert [r["text"] for r in lines.dedup_lines(docs.withColumn("runs", F.lit(1))).orderBy("doc_id").collect()][:3] == texts[:3]
    plan = lines.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "_packed(" in plan
