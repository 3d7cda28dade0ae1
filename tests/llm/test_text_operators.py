"""Operators that take a text and give numbers, ids or spans: library, brute force, edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from vedette.llm import bpe, fingerprints, lm, secrets, toxicity, unigram
from vedette.llm.queries import QUERIES
from vedette.llm.pieces import read_model

with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
    MODEL = file.read()
TABLE = read_model(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
SCHEMA = "doc_id long, text string, ids string, score string, n_tokens string, spans string, block string"
EDGES = ["", " ", "  a", "\n\n", "▁x", "x\0y", "é😀", "a" * 3_000, "the " * 2_000, "=" * 999 + " " * 40]


@pytest.fixture(scope="module")
def edges(spark):
    """Null ids and texts, repeated rows, long texts, columns that clash."""
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(3, EDGES[3]), (None, "no id"), (77, None), (77, None), (None, None)]
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


def texts(st_pieces=tuple(TABLE.words)):
    return st.one_of(st.text(max_size=40), st.text("ab ▁!=-\n", max_size=40),
                     st.lists(st.sampled_from(st_pieces), max_size=10).map("".join))


@settings(max_examples=300, deadline=None)
@given(texts())
def test_encoding_is_the_librarys(text):
    coder = bpe._of(bpe.Encoder, MODEL)
    ids = LIBRARY.encode(text)
    assert coder.ids(text) == ids
    assert bpe._of(bpe.Decoder, MODEL).text(ids) == LIBRARY.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(3, 31_999), max_size=20))
def test_decoding_of_any_ids_is_the_librarys(ids):
    assert bpe._of(bpe.Decoder, MODEL).text(ids) == LIBRARY.decode(ids)


def test_encode_and_decode_edges(edges):
    rows = bpe.decode(bpe.encode(edges, MODEL), MODEL).collect()
    assert len(rows) == edges.count()
    for r in rows:
        want = LIBRARY.encode(r["text"] or "")
        assert r["ids"] == want and r["decoded"] == LIBRARY.decode(want)
    assert bpe.encode(edges.limit(0), MODEL).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(read_model(MODEL.replace(b"\x18\x02 \x80\xfa\x01", b"\x18\x01 \x80\xfa\x01")))


@pytest.fixture(scope="module")
def unigram_library():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(MODEL)
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        if piece.type == 1:
            piece.score = max(piece.score, -32_000.0)
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


@settings(max_examples=300, deadline=None)
@given(texts())
def test_unigram_counts_are_the_librarys(unigram_library, text):
    counter = unigram._ready.setdefault((MODEL, -32_000.0), unigram.Counter(TABLE, -32_000.0))
    assert counter.count(text)[0] == len(unigram_library.encode(text))


def test_token_counts_edges(edges, unigram_library):
    rows = unigram.token_counts(edges, MODEL, -32_000.0).collect()
    assert len(rows) == edges.count()
    for r in rows:
        assert r["n_tokens"] == len(unigram_library.encode(r["text"] or ""))
        assert (r["best_score"] == 0) == (not r["text"])
    assert unigram.token_counts(edges.limit(0), MODEL).count() == 0


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [("assign", m.start(), m.end(), 0) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], x[3]))


SECRETS = ["token=abc token=abcdef", "secret=token: abcdefgh", "😀é PassWord : 'hunter22'", "AKIA" + "A" * 15 + " AKIA" + "B" * 16,
           "0123456789abcdef01234567" * 3, "api_key=" + "f" * 30, "API-KEY=zzzzzzz", "password=abcde", "x" * 50_000 + "passwd:123456",
           "token=" + "q" * 5 + "\ntoken=" + "q" * 6, "secret\n=abcdefgh", ("apikey=abc123 " * 300)]


def test_base_spans_are_brute_force(spark, edges):
    docs = edges.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(SECRETS)], "doc_id long, text string"),
                             allowMissingColumns=True)
    docs = docs.unionByName(docs.where("doc_id = 100"))
    rows = secrets.digest(secrets.scan_secrets(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = base_spans(r["text"] or "")
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w[3] == k for w in want) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in want).encode()).hexdigest()
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text,kinds", [
    ("K" * 40, []),
    ("AKIA" + "A" * 16 + " " + "k" * 39 + "K", ["access", "key"]),
    ("AKIA" + "A" * 16 + "\n\n" + "k" * 39 + "K", ["access"]),
    ("AKIA" + "A" * 16 + " " * 500 + "k" * 39 + "K", ["access"]),
    ("ASIA" + "A" * 16, []),
    ("ASIA" + "A" * 16 + " secret=abcdefgh", ["id", "assign"]),
    ("https://db.example.com/x", []),
    ("https://db.example.com/x token: abcdefgh", ["endpoint", "assign"]),
])
def test_weak_candidates_need_company(spark, text, kinds):
    row = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s["kind"] for s in row["spans"]] == kinds


def test_toxicity_learns_words_and_finds_sentences(spark):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = [f"w{(i * 7 + k * k) % 90}" for k in range(30)]
        text = " ".join(words[:10]) + ". " + " ".join(words[10:]) + ("! you rotten villain" if toxic else "")
        rows.append((i, text))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "villain"), (5, rows[5][1])], "doc_id long, text string")
    docs = docs.selectExpr("*", "'x' AS score", "'x' AS offending", "'x' AS _scored")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (4000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    out = toxicity.score_toxicity(docs, model).collect()
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert (r["score"] > 0.5) == (r["doc_id"] % 5 == 0)
        if "villain" in (r["text"] or ""):
            assert any("villain" in r["text"][p["start"]:p["end"]] for p in r["offending"])
    none = toxicity.train(docs, lab.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_on_held_out_labels(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.withColumn("out", toxicity.held_out())
    model = toxicity.train(docs, known.where("not out"))
    got = [(r["toxic"], r["score"]) for r in toxicity.score_toxicity(docs, model).join(known.where("out"), "doc_id").collect()]
    pos, neg = [s for y, s in got if y], [s for y, s in got if not y]
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert wins / (len(pos) * len(neg)) > 0.75


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60), st.integers(0, 20), st.integers(0, 20))
def test_longest_common_extension(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    want = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
    assert fingerprints.PrefixHash(a).extension(i, fingerprints.PrefixHash(b), j) == want


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80), st.text(max_size=80))
def test_likeness(a, b):
    f, g = fingerprints.fingerprint(a), fingerprints.fingerprint(b)
    assert (f == g) == (a == b)
    x = fingerprints.likeness(f, g)
    assert 0 <= x <= 1 and (x == 1) == (a == b) and x == fingerprints.likeness(g, f)


def test_fingerprints_of_long_texts():
    text = "".join(random.Random(3).choices("abcdefghijklmnop ", k=200_000))
    edited = text[:140_000] + text[:60_000][::-1]
    f = fingerprints.fingerprint(text)
    assert 0.6 < fingerprints.likeness(f, fingerprints.fingerprint(edited)) < 0.9
    assert fingerprints.likeness(f, fingerprints.fingerprint(text[::-1])) < 0.1
    p = fingerprints.PrefixHash(text)
    assert p.extension(0, fingerprints.PrefixHash(edited), 0) >= 140_000
    assert fingerprints.likeness(fingerprints.fingerprint("ab" * 100_000), fingerprints.fingerprint("ab" * 100_000 + "c")) > 0.9


def test_fingerprints_of_texts_that_end_just_behind_a_block(monkeypatch):
    r = random.Random(7)
    texts = ["".join(r.choices("abcdefghijklmnop ", k=k * fingerprints.BLOCK + more)) for k in (1, 2) for more in (0, 1, 14, 15, 16)]
    found = [fingerprints.fingerprint(t) for t in texts]
    monkeypatch.setattr(fingerprints, "BLOCK", 4 * fingerprints.BLOCK)
    monkeypatch.setattr(fingerprints, "_tables", {})
    assert found == [fingerprints.fingerprint(t) for t in texts]


def test_next_rows_over_many_ranges_and_batches(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 37)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 7)
    r = random.Random(5)
    data = [(r.choice([None, *range(-40, 200)]), f"t{r.randrange(50)}") for _ in range(600)]
    found = fingerprints.with_next(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", ["text"], {"up": str.upper})
    got = [tuple(x) for x in found.select("doc_id", "text", "up", "next_text", "next_up").collect()]
    spark.conf.set(batch, before)
    order = sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = [(i, t, t.upper(), n, n.upper()) for (i, t), (_, n) in zip(order, order[1:] + order[:1])]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert "Window" not in found._jdf.queryExecution().toString()  # would hold the texts of a range


def test_fingerprint_documents(spark):
    data = [(5, "abcdefghi"), (9, "0123456789"), (2, ""), (7, None), (1, "zz"), (30, "x" * 100_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' AS fingerprint", "'x' AS next_text")
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    order = sorted(data, key=lambda r: -r[0])
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_text"] == edited
        assert r["fingerprint"] == fingerprints.fingerprint(text)
        assert r["edited_fingerprint"] == fingerprints.fingerprint(edited)
        assert r["near_next"] == fingerprints.likeness(r["fingerprint"], fingerprints.fingerprint(following))
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id long, text string")
    assert fingerprints.fingerprint_documents(odd).count() == 4


def test_lm_scores_are_brute_force(spark, edges):
    order, least = 4, 2
    corpus = [r["text"] or "" for r in edges.collect()]
    counts = Counter()
    for t in corpus:
        for i in range(len(t)):
            for k in range(order + 1):
                counts[(t[i:i + k] + "\0" * order)[:k]] += 1

    def want(t):
        total = 0.0
        for i in range(len(t)):
            for k in range(min(order, i + 1), 0, -1):
                gram = t[i - k + 1:i + 1]
                if counts[gram] >= least:
                    total += math.log(counts[gram] / counts[gram[:-1]]) + math.log(0.4) * (order - k)
                    break
            else:
                total += math.log(0.4) * order - math.log(counts[""])
        return total

    scored = lm.score_documents(edges, order=order, least=least).collect()
    assert len(scored) == len(corpus)
    by_id = {}
    for r in scored:
        by_id.setdefault(r["doc_id"], []).append(r["log_score"])
    for i, t in enumerate(EDGES):
        assert all(abs(s - want(t)) < 1e-6 * max(1, len(t)) for s in by_id[i])
    assert lm.score_documents(edges.limit(0)).count() == 0


def test_lm_scores_count_rare_grams(spark):
    """By default a gram seen once scores by its count, not as an unknown character."""
    docs = spark.createDataFrame([(1, "abcde"), (2, "abcdx")], "doc_id long, text string")
    got = {r["doc_id"]: r["log_score"] for r in lm.score_documents(docs).collect()}
    start = math.log(2 / 10) + 3 * math.log(1) + math.log(0.4) * (4 + 3 + 2 + 1)
    assert all(abs(s - (start + math.log(1 / 2))) < 1e-9 for s in got.values())


def test_secret_query_finds_company_anywhere_in_a_block(spark, tmp_path):
    identifier, key = "ASIA" + "A" * 16, "k" * 39 + "K"
    far = "\n".join(["x = 1"] * 300)
    rows = [(1, f"{identifier}\n{far}\n{key}"), (2, f"{key}\n{far}\n{identifier}"), (3, f"{identifier}\n{far}\n\n{key}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: [s.split(":")[0] for s in r["spans"].split(",") if s] for r in QUERIES["op6_secret_scan"](spark, str(tmp_path)).collect()}
    assert got == {1: ["id", "key"], 2: ["key", "id"], 3: []}


def test_tokens_agree_without_merging_them_anew(monkeypatch):
    coder = bpe.Encoder(read_model(MODEL))
    rng, pieces = random.Random(4), sorted(coder.valid)
    short = [p for p in pieces if len(p) < 4 or len(set(p)) < 3]
    pairs = [(rng.choice(pieces if i % 2 else short), rng.choice(pieces if i % 3 else short)) for i in range(4_000)]
    want = [coder.merged(a + b) == [a, b] for a, b in pairs]
    assert [coder.stay_apart(a, b) for a, b in pairs] == want and len(set(want)) == 2
    monkeypatch.setattr(coder, "merged", None)
    for (a, b), w in zip(pairs, want, strict=True):
        if not coder.unordered & {a, b} and "▁▁" not in a + b:
            assert coder.agree(a, b) == w


def test_many_texts_are_coded_as_each_by_itself():
    coder, decoder, rng = bpe.Encoder(read_model(MODEL)), bpe._of(bpe.Decoder, MODEL), random.Random(5)
    words = ["", " ", "▁", "a", "the", "é", "　漢字", "\n", "😀😀", "x" * 90, "token."]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(9))) for _ in range(400)]
    for some in (pa.array(texts), pa.array(["aside", *texts])[1:], pa.array([], pa.string()), pa.array([""])):
        found = coder.lists(some)
        assert found.to_pylist() == [LIBRARY.encode(t) for t in some.to_pylist()]
        assert decoder.texts(found).to_pylist() == [LIBRARY.decode(x) for x in found.to_pylist()]
    ids = [None if rng.random() < .1 else [rng.randrange(3, 300 if rng.random() < .5 else 32_000) for _ in range(rng.randrange(6))] for _ in range(300)]
    for some in (ids, *([x] for x in ids)):
        got = decoder.texts(pa.array(some, pa.list_(pa.int32()))).to_pylist()
        assert got == [None if x is None else LIBRARY.decode(x) for x in some]


def test_texts_are_encoded_once_for_ids_and_decoded_text(spark, tmp_path):
    spark.createDataFrame([(1, "a text")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["op1_sentencepiece"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("coded(coalesce(") == 1 and plan.count("ArrowEvalPython") == 1 and "texts(ids(" not in plan
    rows = spark.createDataFrame([("a text",), (None,), ("",)], "text string")
    assert bpe.encode_and_decode(rows, MODEL).collect() == bpe.decode(bpe.encode(rows, MODEL), MODEL).collect()
