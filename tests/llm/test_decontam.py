"""Benchmark passages against edit distance over whole texts."""

import random

import pytest

pytest.importorskip("numpy")
from vedette.llm import decontam  # noqa: E402


def edited(r, text, edits):
    chars = list(text)
    for _ in range(edits):
        j = r.randrange(len(chars))
        kind = r.randrange(3)
        if kind == 0:
            chars[j] = r.choice("abcdeñ xyz")
        elif kind == 1 and len(chars) > 1:
            del chars[j]
        else:
            chars.insert(j, r.choice("abcde xyz"))
    return "".join(chars)


def prose(r, words):
    return " ".join("".join(r.choice(["th", "in", "ra", "os", "ción", "ed", "re", "la"]) for _ in range(r.randint(1, 4))) for _ in range(words))


def expected(items, text, share):
    text, out = decontam.plain(text), []
    for i, item in enumerate(items):
        most = int(share * len(item))
        near = decontam.distance_within(item, text, most)
        if near:
            out.append((i, near[1], near[0]))
    return out


@pytest.mark.parametrize(("seed", "share"), [(1, 0.2), (2, 0.2), (3, 0.1), (4, 0.35), (5, 0.04)])
def test_every_passage_within_the_edits_is_found(seed, share, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(decontam, "PLACES", 700)
    monkeypatch.setattr(decontam, "HITS", 2_000)
    items = [decontam.plain(prose(r, r.randint(4, 60))) for _ in range(25)] + ["q", "ab", "abc d", "the ra in", "ction osla edre", "ra los 1234567"]
    texts = ["", " ", "abd"]
    for k in range(60):
        item = items[k % 25]
        most = int(share * len(item))
        passage = edited(r, item, r.choice([most, most, most - 1, most // 2]) if most else 0)
        texts.append(prose(r, r.randint(0, 80)) + " " + passage.upper() + " " + prose(r, r.randint(0, 80)))
    texts += [edited(r, items[k], int(share * len(items[k]))) for k in range(25)]
    found = decontam.Items(list(range(len(items))), items, share, 10).scan(texts)
    assert found == [expected(items, t, share) for t in texts]
    assert sum(len(f) for f in found) > 70


def test_evenly_spread_edits_leave_no_long_run(spark):
    """Every fifth character replaced: no six characters in a row survive."""
    r = random.Random(7)
    item = decontam.plain(prose(r, 40))
    cut = len(item) // 5 * 5
    spread = "".join("#" if j % 5 == 4 else c for j, c in enumerate(item[:cut])) + item[cut:]
    docs = spark.createDataFrame([(1, prose(r, 50) + " " + spread + " " + prose(r, 50)), (2, prose(r, 100)), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [(x["doc_id"], x["item_id"], x["distance"]) for x in decontam.leaks(docs, bench).collect()] == [(1, 9, cut // 5)]
    assert sorted(x["doc_id"] for x in decontam.without_leaks(docs, bench).collect()) == [2, 3]


def test_pieces_with_one_edit_are_found_and_few_halves_are_compared(monkeypatch):
    rng = random.Random(6)
    item = "".join(rng.choice("abcdefgh ") for _ in range(96))
    compared, one_edit = [0], decontam._one_edit

    def counted(word, *rest):
        compared[0] += len(word)
        return one_edit(word, *rest)

    monkeypatch.setattr(decontam, "_one_edit", counted)
    for share in (0.05, 0.1, 0.2, 0.3):
        items = decontam.Items([1], [item], share, 1)
        pieces = int(items.most[0]) // 2 + 1
        for p in range(pieces):
            a, b = len(item) * p // pieces, len(item) * (p + 1) // pieces
            for at in range(a, b):
                for edited in (item[a:at] + "#" + item[at + 1:b], item[a:at] + "#" + item[at:b], item[a:at] + item[at + 1:b]):
                    text = "~" * 30 + edited + "~" * 30
                    seeds = [x for found in items._seeded(decontam._classes(decontam._codes(text))) for x in (found[0] - found[2]).tolist()]
                    assert any(abs(x - (30 - a)) <= 1 for x in seeds), (share, p, at, edited)
    items = decontam.Items(list(range(60)), [prose(rng, 20) for _ in range(60)], 0.2, 1)
    text, compared[0] = prose(rng, 5_000), 0
    for _ in items._seeded(decontam._classes(decontam._codes(text))):
        pass
    assert 0 < compared[0] < 2 * len(text)
