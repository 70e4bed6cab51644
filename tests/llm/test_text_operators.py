"""Training-data operators against brute force, and on the cases that break things."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import canonical, duck
from meridian.llm import ann, common, components, importance, language_id, licenses, mixing, pieces, pii, quality_rules, simhash, substring_dedup
from meridian.llm.queries import ORACLES, QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, key long"


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows, ids that repeat, clashing names."""
    long = " ".join(f"w{i % 5000}" for i in range(20_000))
    rows = [
        (1, "the cat sat on the mat " * 9, "en", "a", 10, "x", 1, 1),
        (1, "the cat sat on the mat " * 9, "en", "a", 10, "x", 1, 1),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, "x", 1, 1),
        (4, " \t\n\r\x0b\x0c ", "de", None, 7, "x", 1, 1),
        (None, "null id here", "de", "b", 12, "x", 1, 1),
        (5, long, "en", "b", len(long), "x", 1, 1),
        (6, "a" * 100_000, None, "c", 100_000, "x", 1, 1),
        (7, "1234 ▁ \0 é́漢😀 @ +1 (555) 123-4567 a@b.co", "fr", "c", 3, "x", 1, 1),
        (1, "other text with the same id", "en", "a", 10, "x", 1, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


LABELS = "doc_id long, quality int, toxic int"
APPLY = {
    "language_id": lambda s, d: language_id.identified(d, language_id.learned(d, F.lit(True))),
    "pieces": lambda s, d: pieces.encoded(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "one_of_each": lambda s, d: simhash.one_of_each(d),
    "quality_rules": lambda s, d: quality_rules.judged(d),
    "substring_dedup": lambda s, d: substring_dedup.removed(d),
    "licenses": lambda s, d: licenses.scanned(d),
    "mixing": lambda s, d: mixing.mix(d),
    "mixed": lambda s, d: mixing.mixed(d),
    "pii": lambda s, d: pii.found(d, pii.trained(d)),
    "redacted": lambda s, d: pii.redacted(d, pii.trained(d)),
    "importance": lambda s, d: importance.resampled(d, s.createDataFrame([(1, 1, 0), (5, 1, 0), (3, 0, 0), (None, 1, 0)], LABELS)),
    "kept_documents": lambda s, d: importance.kept_documents(d, s.createDataFrame([], LABELS)),
}


@pytest.mark.parametrize("name", sorted(APPLY))
def test_odd_rows_and_empty_tables(spark, odd, name):
    n = APPLY[name](spark, odd).count()
    if name not in ("one_of_each", "mixed"):
        assert n == odd.count()
    assert APPLY[name](spark, odd.limit(0)).count() == 0


def by_id(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r.doc_id].append(r)
    return out


def test_what_odd_rows_give(spark, odd):
    """Null, empty and blank texts (2, 3, 4), a null id, repeated rows and an id of two texts (1), and clashing names."""
    blank = (2, 3, 4)
    got = by_id(APPLY["language_id"](spark, odd).collect())
    assert all(got[i][0].lang_pred == "und" and got[i][0].score == 0 for i in blank) and got[None][0].lang_pred != "und"

    got = by_id(pieces.encoded(odd).collect())
    assert got[2][0].ids is None and got[3][0].ids == [] and all(r.lossless for rows in got.values() for r in rows)
    assert len({tuple(r.ids) for r in got[1]}) == 2 and got[2][0].n_tokens == got[3][0].n_tokens == 0 < got[4][0].n_tokens

    got = by_id(quality_rules.judged(odd).collect())
    assert all((got[i][0].n_words, got[i][0].n_symbols, got[i][0].base_failed, got[i][0].kept) == (0, 0, True, False) for i in blank)
    assert len({tuple(r) for r in got[1]}) == 2

    got = by_id(substring_dedup.removed(odd).collect())
    assert all((got[i][0].n_words, got[i][0].n_removed) == (0, 0) for i in blank)
    assert sorted((r.n_words, r.n_removed) for r in got[1]) == [(6, 0), (54, 54), (54, 54)]

    got = by_id(licenses.scanned(odd).collect())
    assert all(r.n_licenses == 0 and r.spans == "" for rows in got.values() for r in rows)

    rows = mixing.mix(odd).collect()
    assert all(r.taken == 0 and r.slots == [None, None] for r in rows if not r["size"])
    took = collections.Counter()
    for r in rows:
        took[r.source] += r.taken
    assert all(abs(took[r.source] - r.target) <= 0.5 for r in rows) and None in took
    rows = mixing.mixed(odd).collect()
    assert all(r.kept == "x" and r["size"] == r.key == 1 and WORDS.search(r.text) and r.n_chars == len(r.text) for r in rows)

    field = pii.trained(odd)
    got = by_id(pii.found(odd, field).collect())
    assert all((got[i][0].n_email, got[i][0].n_phone, got[i][0].base, got[i][0].spans) == (0, 0, "", "") for i in blank)
    assert (got[7][0].n_email, got[7][0].n_phone) == (1, 1)
    rows = {tuple(r)[2:] + (r.doc_id,): r for r in pii.redacted(odd, field).collect()}
    assert {tuple(r)[2:] + (r.doc_id,) for r in odd.collect()} == set(rows)
    texts = by_id(rows.values())
    assert texts[2][0].text is None and texts[3][0].text == "" and texts[7][0].text.endswith("<PHONE> <EMAIL>")

    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (3, 0, 0), (None, 1, 0)], LABELS)
    got = by_id(importance.resampled(odd, labels).collect())
    assert all(got[i][0].log_weight == 0 for i in blank) and len({r.key - r.log_weight for r in got[1]}) <= 2
    kept = importance.kept_documents(odd, spark.createDataFrame([], LABELS))
    assert kept.columns == odd.columns and collections.Counter(map(tuple, kept.collect())) == collections.Counter(map(tuple, odd.collect()))

    left = simhash.one_of_each(odd)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 1, 2, 5, 6, 7]
    named = spark.createDataFrame([("b", "x y"), ("a", None)], "doc_id string, text string")
    assert {(r.doc_id, r.n_words) for r in quality_rules.judged(named.withColumn("lang", F.lit("en"))).collect()} == {("b", 2), ("a", 0)}
    assert {(r.doc_id, r.lang_pred) for r in language_id.identified(named, language_id.Trees({}, language_id.Plan())).collect()} == {("b", "und"), ("a", "und")}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, small, name):
    assert (canonical(QUERIES[name](spark, small).toPandas()) == canonical(duck(ORACLES[name], small))).all().all()


# ---- language identification


def test_code_lengths_are_exact(texts):
    sample = {"x": list(texts.values())[:6], "y": list(texts.values())[6:12]}
    trees = language_id.Trees(sample, language_id.Plan())
    line = language_id.prepared(list(texts.values())[20][:800])

    def bits(lang):
        counts = [collections.defaultdict(collections.Counter) for _ in range(5)]
        for t in sample[lang]:
            b = b"\0" * 4 + language_id.prepared(t)
            for i, k in itertools.product(range(4, len(b)), range(5)):
                counts[k][b[i - k : i]][b[i]] += 1
        total, b = 0.0, b"\0" * 4 + line
        for i in range(4, len(b)):
            for k in range(4, -1, -1):
                c = counts[k].get(b[i - k : i])
                if c is None:
                    continue
                n = c.total()
                if c[b[i]]:
                    total += math.log2((n + len(c)) / c[b[i]])
                    break
                total += math.log2((n + len(c)) / len(c))
            else:
                total += 8
        return total

    assert trees.totals([line])[0] == pytest.approx([bits("x"), bits("y")], rel=1e-6)


def test_language_of_held_out_documents(spark, small, docs):
    rows = QUERIES["op1_language_id"](spark, small).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_every_language_with_text_is_learned(spark):
    rows = [(i, "kurze zeilen in aa " * 4, "aa") for i in range(50)]
    rows += [(100 + i, "zq vx long lines of bb " * 20_000, "bb") for i in range(2)]
    rows += [(200, "one only ünd short", "cc"), (201, None, "dd"), (202, "", "ee"), (203, "no name", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for size in (20_000, 300):
        trees = language_id.learned(d, F.lit(True), language_id.Plan(sample_bytes=size))
        assert trees.langs == ["aa", "bb", "cc"]
        assert {r.doc_id: r.lang_pred for r in language_id.identified(d.filter("doc_id in (1, 100)"), trees).collect()} == {1: "aa", 100: "bb"}
        assert len(trees.known) < 2 * size


def test_no_letters_is_undetermined(spark, odd):
    got = {r.doc_id: r.lang_pred for r in APPLY["language_id"](spark, odd.filter("doc_id in (2, 3, 4, 5)")).collect()}
    assert got[2] == got[3] == got[4] == "und" and got[5] != "und"


# ---- pieces


def test_without_dropout_as_the_library(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    coder = pieces.Encoder(pieces.Vocabulary(), pieces.Plan(dropout=0.0))
    for i, t in list(texts.items())[:80]:
        assert coder.encode(t, i).tolist() == model.encode(t)


def test_agendas_together_as_one_by_one(texts):
    v, coder = pieces.Vocabulary(), pieces.Encoder(pieces.Vocabulary(), pieces.Plan())
    words = sorted({w for t in list(texts.values())[:40] for w in coder.find(" " + t) if 0 < len(w) <= pieces.LONG}) + ["▁▁x", "   ", "a▁b", "\0q", "é́漢😀"]
    keys = np.random.default_rng(1).integers(0, 1 << 63, len(words)).astype(np.uint64)
    for limit in (0, 1 << 29, 1 << 31):
        ids, sizes = v.segment_all(words, keys.copy(), limit)
        got = np.split(ids, np.cumsum(sizes)[:-1])
        assert all(g.tolist() == v.segmented(w, int(k), limit) for g, w, k in zip(got, words, keys, strict=True))


def test_each_place_draws_its_own_segmentation(texts):
    v = pieces.Vocabulary()
    for dropout, kept in ((0.1, 60_000), (0.4, 50)):
        coder = pieces.Encoder(v, pieces.Plan(dropout=dropout, kept=kept))
        rows = [(t, i) for i, t in list(texts.items())[:60]] + [("a" * 200 + " ▁é\0 漢" * 3, 7), ("", 8)]
        got = [ids for at in range(0, len(rows), 9) for ids in coder.encode_all(rows[at : at + 9])]
        for (t, i), ids in zip(rows, got, strict=True):
            words = coder.find(" " + t) if t else []
            start = np.uint64(i * 2 + coder.plan.seed)
            keys = pieces.mix(pieces.mix(np.arange(len(words), dtype=np.uint64) * pieces.ODD + start) + start).tolist()
            assert ids.tolist() == [n for w, k in zip(words, keys, strict=True) for n in v.segmented(w, k, coder.limit)]
    word = "segmentation "
    ids = pieces.Encoder(v, pieces.Plan(dropout=0.3)).encode(word * 2000, 1)
    cut = [i for i, n in enumerate(ids.tolist()) if bytes(v.bytes[v.places[n] : v.places[n] + v.sizes[n]]).startswith(b" ")]
    forms = {tuple(ids[a:b].tolist()) for a, b in zip(cut, cut[1:], strict=False)}
    assert len(forms) > 40  # a word is not held to a few ways


def test_documents_named_by_texts(spark):
    d = spark.createDataFrame([("a", "some words of a text " * 20), ("b", "some words of a text " * 20), (None, "x")], "doc_id string, text string")
    got = {r.doc_id: r for r in pieces.encoded(d).collect()}
    assert all(r.lossless for r in got.values()) and got["a"].ids != got["b"].ids


def test_dropout_varies_and_decodes(texts):
    v = pieces.Vocabulary()
    a, b = pieces.Encoder(v, pieces.Plan(dropout=0.3, seed=1)), pieces.Encoder(v, pieces.Plan(dropout=0.3, seed=2))
    t = max(texts.values(), key=len)
    assert a.encode(t, 1).tolist() == pieces.Encoder(v, pieces.Plan(dropout=0.3, seed=1)).encode(t, 1).tolist()
    assert a.encode(t, 1).tolist() != b.encode(t, 1).tolist() != a.encode(t, 2).tolist()
    for x in [t, "", " ", "\n", "▁a ▁ b", "a\0b", "é́漢😀▁▁", "a" * 500, "  x  \n\n y "]:
        assert a.decode(a.encode(x, 3)) == x


def test_ids_decode_in_tables(spark, odd):
    back = {(r.doc_id, r.text) for r in pieces.decoded(pieces.encoded(odd)).collect()}
    assert back == {(r.doc_id, r.text) for r in odd.collect()}
    assert pieces.encoded(odd).filter("not lossless").count() == 0


# ---- near-duplicates


def fingerprint(t):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def connected(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("most", [simhash.MOST_IN_TRIE, 1])
def test_fingerprints_and_components(spark, docs, texts, monkeypatch, most):
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda heads, budget=3: links(heads, budget, most))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    want = {i: fingerprint(t) for i, t in texts.items()}
    assert all(got[i].fp % (1 << 64) == f for i, f in want.items())
    pairs = [(a, b) for a, b in itertools.combinations(want, 2) if (want[a] ^ want[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in got.items()} == connected(want, pairs)


def test_trie_join_finds_every_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    keys = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(6)})
    arr = np.array(keys, np.uint64)
    whole = [np.array([0]), np.array([len(arr)]), np.array([0]), np.array([len(arr)])]
    found = {tuple(sorted(p)) for i, j in simhash.join_tries(arr, whole, 3, 0) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert found == {(a, b) for a, b in itertools.combinations(range(len(keys)), 2) if (keys[a] ^ keys[b]).bit_count() <= 3}


def test_one_of_each_group_stays(docs, texts):
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in texts.items()}
    alike = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert alike
    left = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert left == {n for n, r in connected(sets, alike).items() if n == r}


def test_near_copies_in_a_group_with_one_template(spark):
    rng = random.Random(11)
    own = lambda n: [f"x{rng.getrandbits(40):x}" for _ in range(n)]
    rows = []
    for i in range(0, 300, 2):  # any two documents are alike by 0.7 to 0.8, some neighbours by about 0.88
        first = [f"t{k}" for k in range(260)] + own(44)
        rows += [(i, " ".join(first)), (i + 1, " ".join(first[:-18] + own(18) if i < 100 else first[:260] + own(44)))]
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    alike = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert alike == [(i, i + 1) for i in range(0, 100, 2)]
    assert len(sets[1] & sets[150]) > 0.7 * len(sets[1] | sets[150])
    left = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == set(sets) - {b for _, b in alike}


@pytest.mark.parametrize("block", [simhash.BLOCK, 7])
def test_clusters_are_compared_exactly_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    own = lambda n: [f"x{rng.getrandbits(40):x}" for _ in range(n)]
    base, other, rows = own(200), own(200), []
    for i in range(60):  # copies of one text, each with a stretch of its own: alike in pairs or only by way of others
        a = rng.randrange(150)
        rows.append((i, " ".join(base[:a] + own(rng.choice([5, 12, 25])) + base[a + 12 :])))
    rows += [(100 + i, " ".join(other[: 200 - 9 * i])) for i in range(12)]  # a chain
    rows += [(200 + i, " ".join(base[:120] + own(80))) for i in range(20)]  # half alike
    rows += [(300, " ".join(base)), (301, " ".join(base)), (302, ""), (303, None)]
    sets = {i: set(simhash.shingle_set((t or "").encode(), 5).tolist()) for i, t in rows}
    alike = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    left = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {n for n, r in connected(sets, alike).items() if n == r}
    assert len(left) < 60


def test_shared_shingles_are_counted():
    rng = np.random.default_rng(6)
    sets = [np.unique(np.concatenate([rng.integers(0, 400, 30), np.arange(1000, 1040)])).astype(np.uint64) for _ in range(70)]
    for side in (np.zeros(70, int), (np.arange(70) >= 30).astype(int)):
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if side.any() else np.arange(70)
        want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
        got = simhash.shared_shingles(sets, side)
        assert all(got[i, j] == want[i][j] for i, j in np.ndindex(got.shape) if left[i] != right[j])  # of others, that is


def test_copies_of_any_form(spark):
    a = " ".join(f"w{i}" for i in range(100))
    rows = [(1, a), (1, a), (2, a.upper()), (3, ""), (4, None), (None, a), (7, "other text"), (7, "other text")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(d).collect()) == [1, 3, 7]
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(d).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (3, 3): 1, (4, 3): 1, (None, None): 1, (7, 7): 2}


# ---- quality rules


def test_base_rules(spark, docs, texts):
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    for i, t in texts.items():
        w = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        at = collections.defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        again = {c for v in at.values() if len(v) > 1 for k in v for c in range(k, k + 8)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (r.kept and r.base_failed)


def test_distances_are_jensen_shannon(spark):
    p, q = [0.5, 0.3, 0.2, 0.0], [0.1, 0.2, 0.3, 0.4]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    want = sum(a * math.log2(a / c) for a, c in zip(p, m, strict=True) if a) + sum(b * math.log2(b / c) for b, c in zip(q, m, strict=True) if b)
    total = sum((quality_rules.term(F.lit(a), F.lit(b)) for a, b in zip(p, q, strict=True)), F.lit(0.0))
    assert spark.range(1).select(total).first()[0] == pytest.approx(want)


def test_good_documents_stay(spark, small, docs):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = quality_rules.judged(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) >= 0.98 * len(good) and sum(bad) < len(bad)


# ---- repeated windows


def removal(texts, width=35):
    words = {i: WORDS.findall(t or "") for i, t in texts.items()}
    seen = collections.Counter(tuple(w[k : k + width]) for w in words.values() for k in range(len(w) - width + 1))
    out = {}
    for i, w in words.items():
        gone = {c for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for c in range(k, k + width)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_repeated_windows_go(docs, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(docs).collect()}
    assert got == removal(texts)
    assert sum(n for _, n, _ in got.values()) > 0


def test_windows_of_one_document_and_hash_ties(spark):
    run = [f"word{i}middle{i}tail" for i in range(60)]
    clash = [w.replace("middle", "MIDDLE") for w in run]  # the same first and last bytes and length
    texts = {1: " ".join(run + ["x"] + run), 2: " ".join(clash), 3: " ".join(run[:34]), 4: "a " * 90, 5: None, 6: " ".join(run[10:50] + ["y"])}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(d).collect()}
    assert got == removal(texts)


# ---- licenses


def test_licenses():
    s = licenses.Scanner()
    names = lambda t: [f[0] for f in s.scan(t)]
    noise = "Thor the and onnd eaha. Er tionthing the. "
    for name, text in (("MIT", "Released under the MIT License."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0.")):
        assert names(noise * 5 + "\n" + text + "\n" + noise * 3) == [name]
        found = s.scan(text)[0]
        assert (found[1], found[3]) == (0, 0)
    assert names("Licensed under the Apache License, Version 1.0.") == []
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("we licensed nothing to anyone") == [] and names("") == []


@pytest.mark.parametrize("n", [3, 4, 6, 12])
def test_adjacent_licenses(n):
    rng, s = random.Random(n), licenses.Scanner()
    short = [(name, wording) for name, wording, _ in licenses.TEMPLATES if len(wording.split()) <= 14]
    for _ in range(10):
        text, want = "", []
        for name, wording in rng.sample(short, min(n, len(short))):
            want.append((name, len(text), len(text) + len(wording)))
            text += wording + " alpha beta gamma delta epsilon "
        got = s.scan(text)
        assert [(f[0], f[3]) for f in got] == [(name, 0) for name, *_ in want]
        assert all(a == f[1] and z - 1 <= f[2] <= z for f, (_, a, z) in zip(got, want, strict=True))
    twice = "Licensed under CC BY 4.0. " * 3
    assert [f[0] for f in s.scan(twice)] == ["CC-BY-4.0"] * 3


@pytest.mark.parametrize("name, wording", [t[:2] for t in licenses.TEMPLATES])
def test_each_license_alone_wrapped_and_in_comments(name, wording):
    s, words = licenses.Scanner(), wording.split()
    lines = [" ".join(words[i : i + 3]) for i in range(0, len(words), 3)]
    for mark in ("", "# ", "// ", " * ", "-- "):
        for parts in ([wording], lines, words):
            text = "".join(f"{mark}{p}\n" for p in parts)
            for around in ("", "other words of the text that are there " * 20):
                assert [(f[0], f[3]) for f in s.scan(around + "\n" + text + around)] == [(name, 0)], (mark, parts)


@pytest.mark.parametrize("seed", range(4))
def test_exact_wordings_at_all_places(seed):
    rng, s = random.Random(seed), licenses.Scanner()
    pool = sorted({w for _, wording, _ in licenses.TEMPLATES for w in wording.split()})
    for _ in range(5):
        words = []
        for _ in range(rng.randint(2, 10)):
            words += rng.choice(licenses.TEMPLATES)[1].split() if rng.random() < 0.7 else rng.sample(pool, rng.randint(1, 30))
            words += ["alpha"] * rng.randint(0, 3)
        text = " ".join(words)
        places = [(m[0], m.start(), m.end()) for m in WORDS.finditer(text) if licenses._plain(m[0])]
        plain = [licenses._plain(w) for w, _, _ in places]
        exact = set()
        for name, wording, _ in licenses.TEMPLATES:
            want = [w for x in wording.split() if (w := licenses._plain(x))]
            exact |= {(name, places[i][1], places[i + len(want) - 1][2]) for i in range(len(plain) - len(want) + 1) if plain[i : i + len(want)] == want}
        longest = {(n, a, z) for n, a, z in exact if not any((c, y) != (a, z) and c < z and a < y and (y - c > z - a or (c <= a and z <= y)) for _, c, y in exact)}
        got = {(n, a, z) for n, a, z, differ, _ in s.scan(text) if not differ}
        assert got <= exact
        assert {(a, z) for _, a, z in longest} <= {(a, z) for _, a, z in got}


# ---- mixing


def test_targets_fill_up(spark):
    sizes = {"a": 100, "b": 10, "c": 400, None: 50}
    rows = [(k, n) for k, n in sizes.items()]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    weights = dict(zip(["a", "b", "c", None], [3, 1, 2, 3], strict=True))
    want, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weights[k] for k in free)
        over = {k for k in free if level * weights[k] > 2 * sizes[k]}
        if not over:
            want |= {k: level * weights[k] for k in free}
            break
        for k in over:
            want[k] = 2.0 * sizes[k]
            left -= want[k]
        free -= over
    assert got == pytest.approx(want)


def test_mix_meets_its_targets(spark, docs, small):
    rows = mixing.mix(docs).collect()
    assert all(0 <= r.taken <= 2 * r["size"] and sum(r.epochs) == r.taken for r in rows)
    took, want = collections.Counter(), {}
    for r in rows:
        took[r.source] += r.taken
        want[r.source] = r.target
    assert all(abs(took[s] - t) <= 0.5 for s, t in want.items())
    text = mixing.mixed(docs)
    assert text.columns == docs.columns
    words = text.select(F.sum(F.size(mixing.words_of(F.col("text"))))).first()[0]
    assert words == sum(took.values())


@pytest.mark.parametrize("max_slots", [4, 100, 5000])
def test_small_sources_meet_their_targets_with_large_blocks(docs, max_slots):
    rows = mixing.mix(docs, max_slots=max_slots).collect()
    took, want = collections.Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and sum(r.epochs) == r.taken
        took[r.source] += r.taken
        want[r.source] = r.target
    assert len(want) == 20 and all(abs(took[s] - t) <= 0.5 for s, t in want.items())


def test_the_mix_follows_the_schedule(spark, docs):
    rows = mixing.mix(docs).collect()
    assert all((w > 0) == (k is not None) for r in rows for w, k in zip(r.epochs, r.slots, strict=True))
    # the schedule by its definition: the source of slot k, and which of its blocks that is
    goal = sorted((r for r in mixing.targets(mixing.sized(docs)).collect() if r.target > 0), key=lambda r: r.sid)
    total = sum(r.target for r in goal)
    edges = np.cumsum([r.target for r in goal]) / total
    k = np.arange(int(total))
    u = (k + 0.5) * mixing.INVERSE_PHI % 1.0
    of = np.minimum(np.searchsorted(edges, u, "right"), len(goal) - 1)
    slots = {g.source: k[of == i] for i, g in enumerate(goal)}
    for r in rows:
        for turn, (w, slot) in enumerate(zip(r.epochs, r.slots, strict=True)):
            first = r["at"] + turn * r.source_size  # blocks are single words here
            if w and first < len(slots[r.source]):
                assert slot == slots[r.source][first]
    # any stretch of the mix holds each source near its share
    order = sorted((k, r.source, w) for r in rows for w, k in zip(r.epochs, r.slots, strict=True) if w)
    half, words = collections.Counter(), 0
    for _, source, w in order:
        if words < total / 2:
            half[source] += w
            words += w
    largest = max(r["size"] for r in rows)
    assert all(abs(half[g.source] - words * g.target / total) <= 0.02 * total + largest for g in goal)
    text = [r.text for r in mixing.mixed(docs).collect()]
    assert len(text) == len(order) and sum(len(WORDS.findall(t)) for t in text) == sum(w for *_, w in order)


def test_rows_that_share_a_text_keep_their_columns(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(1, words, "en", "a", 5), (1, words, "de", "a", 9), (1, words, "de", "a", 9), (None, words, "fr", "b", 1), (None, words, "fr", "b", 1), (2, "", "en", "c", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_rid long")
    got = collections.Counter()
    for r in mixing.mixed(d).collect():
        got[r.doc_id, r.lang, r.mix_rid] += len(r.text.split())
    plan = mixing.mix(d).collect()
    assert sum(got.values()) == sum(r.taken for r in plan) and {(1, "en", 5), (1, "de", 9)} <= set(got) | {(None, "fr", 1)}
    assert sum(n for (i, *_), n in got.items() if i == 1) == round(next(r.target for r in plan if r.source == "a"))
    again = collections.Counter()
    for r in mixing.mixed(d).collect():
        again[r.doc_id, r.lang, r.mix_rid] += len(r.text.split())
    assert got == again


# ---- personal data


def patterns(t):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in kinds.items():
        spans = []
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            odd = sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255) or (kind == "card" and (not 13 <= len(d) <= 19 or odd)) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            spans.append(m.span())
        out.append(spans)
    return out


def test_patterns_equal_plain_ones(texts):
    rng = random.Random(3)
    made = ["".join(rng.choice("a1.@-+ ()2%9_\n") for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    made += ["".join(rng.choice("0123456789 -.+") for _ in range(rng.randint(10, 40))) for _ in range(20_000)]
    for t in [*texts.values(), *made]:
        assert pii.matched(t) == patterns(t)


@pytest.fixture(scope="module")
def field(spark):
    """A field trained on made documents with one match of each kind and plain numbers."""
    rng = random.Random(8)
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    rows = []
    for i in range(240):
        body = number(15)
        card = next(body + c for c in "0123456789" if pii.luhn(body + c))
        ip = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        found = [f"{rng.choice(['mary', 'john', 'kim'])}.{number(3)}@mail{rng.randint(1, 9)}.example.com", ip, card, f"+1 ({number(3)}) 555-{number(4)}"]
        words = [rng.choice(["the", "in", "year", "of", number(4), number(7), "house", "3.5"]) for _ in range(60)]
        for m in rng.sample(found, 2):
            words.insert(rng.randrange(len(words)), m)
        rows.append((i, " ".join(words)))
    return pii.trained(spark.createDataFrame(rows, "doc_id long, text string"))


def test_links_add_what_is_repeated_in_part(field):
    plan = pii.Plan()
    cases = [
        (0, "mary.447@mail2.example.com", "mary.447", "john.981"),
        (2, "4111111111111111", "11111111", "52839174"),
        (3, "+1 (555) 123-4567", "1234567", "7654328"),
        (3, "+1 (555) 123-4567", "123-4567", "765-4328"),
    ]
    for kind, whole, part, other in cases:
        text = f"write to {whole} in the house of the year. Later on they asked for {part} in that house"
        base, every = pii.both(text, field, plan)
        at = text.rindex(part)
        assert base[kind] == [(text.index(whole), text.index(whole) + len(whole))]
        assert every[kind] == [*base[kind], (at, at + len(part))], part
        # the same words without the link are not personal data, nor is the part without the whole
        for clean in (text[:at] + other + text[at + len(part) :], text.replace(whole, "nobody")):
            base, every = pii.both(clean, field, plan)
            assert base == every, clean


def test_held_out_mentions_are_recovered(field, texts):
    found = collections.Counter()
    plan = pii.Plan()
    for t in texts.values():
        spans = pii.matched(t)
        text, held = pii.with_mentions(t, spans, [(3, "+1 (999) 888-7776")] if any(spans) else [], 5)
        base, every = pii.both(text, field, plan)
        for a, b, label in held:
            hit = any(x < b and a < y for k, of in enumerate(every) for x, y in of if not label or k == label - 1)
            found[bool(label), hit] += 1
    assert found[True, True] >= 0.8 * (found[True, True] + found[True, False]) > 0
    assert found[False, True] <= 0.1 * (found[False, True] + found[False, False])


def test_redaction_and_clean_texts(field):
    assert pii.both("plain words only, version 3 and 4.0 of 2024", field, pii.Plan())[1] == [[], [], [], []]
    assert pii.redact("a b@c.de f", [[(2, 8)], [], [], []]) == "a <EMAIL> f"


def test_a_text_that_does_not_fit_the_sample_is_passed_over(spark):
    long = (0, "9 " * 4000)
    rows = [long] + [(i, f"call +1 (555) 555-{1000 + i} now or {1000 + i} then") for i in range(1, 60)]
    field = pii.trained(spark.createDataFrame(rows, "doc_id long, text string"), pii.Plan(sample_bytes=2000, longest=10_000))
    assert np.abs(field.pair).max() > 0.5


def test_message_passing_is_exact_on_a_chain():
    field = pii.Field(4)
    rng = np.random.default_rng(0)
    field.node, field.pair = rng.normal(size=field.node.shape), rng.normal(size=field.pair.shape)
    g = pii.Graph("10 20 30", [[], [], [], []], 4)
    score, k = field.scores(g.features), 5
    want = np.zeros((3, k))
    for y in itertools.product(range(k), repeat=3):
        w = math.exp(sum(score[i, y[i]] for i in range(3)) + field.pair[0, y[0], y[1]] + field.pair[0, y[1], y[2]])
        for i in range(3):
            want[i, y[i]] += w
    assert field.marginals(g, 200) == pytest.approx(want / want.sum(axis=1, keepdims=True), abs=2e-3)


# ---- importance resampling


def test_counts_equal_brute_force(spark, docs, texts):
    plan = importance.Plan(bits=8, full=10**9)
    ids = np.array(sorted(texts)[:30], np.int64)
    target, raw = importance.count(docs, ids, plan)
    want = [np.zeros(256, np.int64), np.zeros(256, np.int64)]
    for i, t in texts.items():
        grams, _ = importance.buckets([b" ".join(t.encode().split())], 8)
        want[1] += np.bincount(grams, minlength=256)
        if i in set(ids.tolist()):
            want[0] += np.bincount(grams, minlength=256)
    assert (target == want[0] * importance.UNIT).all() and (raw == want[1] * importance.UNIT).all()


def test_weights_keys_and_draws_equal_brute_force(spark, small, docs, texts):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    for plan in (importance.Plan(bits=10), importance.Plan(bits=10, k=40), importance.Plan(bits=10, full=16, lost=0.1)):
        fit, held = (set(x.tolist()) for x in importance.good_labels(labels, plan))
        grams = {i: importance.buckets([b" ".join(t.encode().split())], 10)[0] for i, t in texts.items()}
        target, raw = np.zeros(1024), np.zeros(1024)
        for i, g in grams.items():
            counts = np.bincount(g, minlength=1024) * (importance.UNIT * plan.full // max(len(g), plan.full)) / importance.UNIT
            raw += counts
            target += counts * (i in fit)
        ratio = (target + plan.prior) / (target.sum() * raw / raw.sum() + plan.prior)
        ratio = np.log(ratio / (raw / raw.sum() * ratio).sum())
        weight = {i: ratio[g].sum() * min(1.0, plan.full / max(1, len(g))) for i, g in grams.items()}
        rows = {r.doc_id: r for r in importance.resampled(docs, labels, plan).collect()}
        assert all(rows[i].log_weight == pytest.approx(w, abs=1e-6) for i, w in weight.items())
        noise = np.array([r.key - r.log_weight for r in rows.values()])
        assert abs(noise.mean() - 0.577) < 0.35 and abs(noise.std() - 1.28) < 0.4  # Gumbel
        k = plan.k or sum(w >= np.quantile([weight[i] for i in held if i in weight], plan.lost) - 1e-9 for w in weight.values())
        best = sorted(rows.values(), key=lambda r: -r.key)[:k]
        assert {r.doc_id for r in rows.values() if r.kept} == {r.doc_id for r in best}
        if plan.k:
            assert {r.doc_id for r in best} != set(sorted(weight, key=lambda i: -weight[i])[:k])  # the noise decides too


def test_the_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(-1e5, 10), 3.5]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").cache()
    for k in (1, 2, 77, 250, 499):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_good_documents_are_drawn(spark, small, docs):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = importance.resampled(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert {(r.doc_id, r.kept) for r in rows} == {(r.doc_id, r.kept) for r in importance.resampled(docs, labels).join(labels, "doc_id").collect()}


# ---- nearest neighbours


def test_recall_and_exact_scores(spark, small):
    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    ids, x = np.array(list(e)), np.stack(list(e.values()))
    found = collections.defaultdict(list)
    for r in QUERIES["op3_ann"](spark, small).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r)
    assert set(found) == {i for i in e if i % 20 == 0}
    hits = 0
    for q, rows in found.items():
        s = x @ e[q]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert all(abs(r.score - e[q] @ e[r.vec_id]) < 1e-9 for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits += len(set(best) & {r.vec_id for r in rows})
    assert hits >= 0.9 * 20 * len(found)


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(100, None), (120, [0.0, 0.0]), (140, [nan, 1.0]), (160, [inf, 1.0]), (180, [1.0, None]), (200, [1.0, 2.0, 3.0]), (220, [0.5, 0.5]), (220, [0.5, 0.5]), (None, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.search(d).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == {0, 20, 40, 220}
    assert got[0] == list(range(1, 21)) and got[40] == list(range(20)) and got[220] == list(range(20))
    assert ann.search(d.limit(0)).count() == 0 and ann.search(d.filter("vec_id = 100")).count() == 0
    assert ann.search(d.filter("vec_id = 20")).count() == 0


@pytest.mark.parametrize("block", [64, 4096])
def test_repeated_rows_and_blocks_lose_no_neighbours(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(12, size=1500)] + 0.3 * rng.normal(size=(1500, 8))).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * 2
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plan = ann.Plan(leaf=40, block=block, visits=16, recall=1.0, calibration=75)
    found = collections.defaultdict(list)
    for r in ann.search(d, plan=plan).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r.vec_id)
    assert len(found) == 75
    for q, got in found.items():  # all queries are calibrated on and reach all of their neighbours
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        assert got == np.lexsort((np.arange(len(x)), -s))[:20].tolist()


def test_the_pipeline(spark, small, docs):
    import corpus_pipeline as c

    rows, stages = docs, []
    for _, stage in c.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows, small).collect(), docs.schema)
        assert rows.columns == docs.columns
        stages.append({r.doc_id for r in rows.collect()})
    assert len(stages[0]) < docs.count() and stages[1] < stages[0] and stages[2] == stages[1]
    before = set(Path(common.shared_dir(spark).removeprefix("file:")).glob("meridian-*"))
    out = c.run(spark, small)
    assert len(set(Path(common.shared_dir(spark).removeprefix("file:")).glob("meridian-*")) - before) == 1  # what out reads
    assert out.count() == rows.count() and out.filter("not lossless").count() == 0


def test_candidates_of_a_large_group_are_linked_as_a_forest():
    # 300 fingerprints that are all candidates of each other, in two deals: no list of their pairs
    rng = np.random.default_rng(5)
    n = 300
    keys = np.uint64(1) << rng.permutation(np.arange(n, dtype=np.uint64) % np.uint64(32))
    same = lambda x: np.full(2 * n, x, np.int64)
    head = np.tile(np.arange(n), 2)
    rows = {"key": np.tile(keys, 2), "deal": np.repeat([1, 2], n), "side": same(0), "split": same(0), "head": head, "group": head, "check": same(0), "check2": same(0)}
    found = list(simhash._local_links(rows, 3, 38))
    parent = np.arange(n)
    for u, v, *_ in found:
        parent = simhash.unite(parent, u, v)
    assert (parent == 0).all()
    assert sum(len(u) for u, *_ in found) < 2 * n
    # what is connected already gets no link
    assert not sum(len(u) for u, *_ in simhash._local_links(rows | {"group": same(7)}, 3, 38))


@pytest.mark.parametrize("most", [components.MOST_TOGETHER, 0])
def test_components_of_few_links_take_few_tasks(spark, monkeypatch, most):
    monkeypatch.setattr(components, "MOST_TOGETHER", most)
    rng = random.Random(8)
    ids = [rng.getrandbits(63) - (1 << 62) for _ in range(400)]
    pairs = [tuple(rng.sample(ids, 2)) for _ in range(180)] + list(itertools.pairwise(ids[:60])) + [(ids[0], i) for i in ids[300:330]]
    pairs += [p[::-1] for p in pairs[:20]] + pairs[:20] + [(ids[70], ids[70])]
    of, group = connected(ids, pairs), f"components-{most}"
    links = spark.createDataFrame(pairs, "u long, v long").repartition(8)
    spark.sparkContext.setJobGroup(group, group)
    got = components.components(links)
    status = spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("other", "other")
    assert got.count() and {r.node: r.root for r in got.collect()} == {i: r for i, r in of.items() if i != r}
    assert components.components(links.limit(0)).isEmpty()
    if most:
        assert len(stages) < 10  # rounds take as many each
