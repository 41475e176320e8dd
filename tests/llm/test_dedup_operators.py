"""Near-duplicate and substring dedup against brute force, and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpyramid.llm import minhash_neardup as M
from gridpyramid.llm import suffix_dedup as S
from gridpyramid.llm import suffix_sort
from gridpyramid.llm.components import components
from gridpyramid.llm.suffix_sort import PrefixHash, classes, suffix_order

SCHEMA = "doc_id long, text string, n long, key string"


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute_components(rows, k):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t, k))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 90))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append("  ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    passage = " ".join(word() for _ in range(40))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(40)]
    texts += ["one", "One", "one two", "a b c d", "A b\tc\nd", "", " ", None, "é É", "é é", " ".join(["same"] * 500)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, near_texts, k):
    rows = list(enumerate(near_texts))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    expect = brute_components(rows, k)
    found = {r["doc_id"]: r for r in M.near_duplicates(df, k=k).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        r = found[i]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(shingle_set(t, k)), expect[i], expect[i] == i)


def test_near_duplicates_branch(spark, near_texts, monkeypatch):
    """With small nodes the trees branch; the recall stays."""
    monkeypatch.setattr(M, "SMALL", 3)
    rows = list(enumerate(near_texts))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    expect = brute_components(rows, 5)
    assert {r["doc_id"]: r["component_id"] for r in M.near_duplicates(df).collect()} == expect


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "a b c d e f"), (8, None), (9, "x y")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    found = sorted(((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in M.near_duplicates(df).collect()), key=str)
    assert found == sorted([(1, 1, True), (1, 1, True), (-1, None, True), (-1, None, True), (7, 1, False), (8, 8, True), (9, 9, True)], key=str)
    assert M.near_duplicates(df.where("false")).count() == 0
    alone = M.near_duplicates(df.where("doc_id = 9")).first()
    assert (alone["component_id"], alone["kept"]) == (9, True)


def test_near_duplicates_of_few_shingles(spark):
    """Five against four shingles, exactly 0.8: the sketch drops none of the pairs."""
    words = [[f"w{pair}x{i}" for i in range(8)] for pair in range(3000)]
    texts = [" ".join(w[:n]) for w in words for n in (8, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in M.near_duplicates(docs, k=4).collect()}
    assert found == {i: i - i % 2 for i in range(len(texts))}


@pytest.mark.parametrize("small", [16, None])
def test_near_duplicates_in_a_templated_table(spark, monkeypatch, small):
    """Pairs just over the threshold among rows that are all nearly as alike: every link is found."""
    if small:
        monkeypatch.setattr(M, "SMALL", small)
    monkeypatch.setattr(M, "BLOCK_ROWS", 70)
    template = [f"t{i}" for i in range(82)]
    texts = []
    for pair in range(200):
        for end in range(2):
            texts.append(" ".join(template + [f"p{pair}x{i}" for i in range(7)] + [f"u{pair}y{end}z{i}" for i in range(11)]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in M.near_duplicates(docs, k=1).collect()}
    assert found == {i: i - i % 2 for i in range(len(texts))}


def test_links_of_a_block():
    """Fewer links than rows, and components as from all pairs."""
    rng = np.random.default_rng(8)
    base = rng.integers(1, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: 60 - i % 9], rng.integers(1, 2**63, i % 13).astype(np.uint64)))) for i in range(80)]
    bits = np.packbits((M.signatures(sets) >> 8 & 1).astype(np.uint8), axis=1).view(np.int64)
    import pandas as pd

    rows = pd.DataFrame({"id": range(80), "n": [len(s) for s in sets], "c": range(80), "t": [s.tobytes() for s in sets]} | {w: bits[:, i] for i, w in enumerate(M.BITS)})
    links = M.block_links(rows, rows, 80)
    parent = list(range(80))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        parent[max(find(u), find(v))] = min(find(u), find(v))
    got, parent = [find(i) for i in range(80)], list(range(80))
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert got == [find(i) for i in range(80)] and len(links) == 80 - len(set(got)) and len(set(got)) < 80


@pytest.mark.parametrize("one_task", [0, 100_000])
def test_components(spark, monkeypatch, one_task):
    from gridpyramid.llm import components as module

    monkeypatch.setattr(module, "ONE_TASK", one_task)
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)] + [(5, 5), (200, 300), (300, 200)]
    links += [(1000, 1000 + i) for i in range(1, 50)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        if u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    assert found == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_removed(rows):
    """doc_id, n_bytes, n_removed, n_spans, digest of rows in order."""
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        edges = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    found = S.substring_dedup(df).select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long"), F.sha2("kept", 256))
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def repeated_texts():
    rng = random.Random(7)
    prose = lambda n: "".join(rng.choice("abcdeé \n日") for _ in range(n))
    passages = [prose(n) for n in (90, 99, 100, 101, 150, 400, 1500)]
    texts = []
    for _ in range(60):
        parts = [prose(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut:] if rng.random() < 0.5 else p, prose(rng.randint(0, 60))]
        texts.append("".join(parts))
    texts += texts[:5] + ["a" * 1000, "a" * 250, "ab" * 300, "", None, "x" * 99, "x" * 100, "x" * 100, prose(30) * 20, "abc" * 33 + "x", "0123456789" * 500]
    rng.shuffle(texts)
    return texts


def test_substring_dedup(spark, repeated_texts):
    rows = list(enumerate(repeated_texts))
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], SCHEMA)
    expect = brute_removed(rows)
    for parts in (1, 5, 60):
        assert digests(df.repartition(parts)) == expect


def test_substring_dedup_in_small_blocks(repeated_texts, spark, monkeypatch):
    monkeypatch.setattr(S, "HASHED", 300)
    monkeypatch.setattr(S, "SORTED", 500)
    monkeypatch.setattr(S, "HELD", 50)
    rows = list(enumerate(repeated_texts))
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], SCHEMA)
    assert digests(df.coalesce(1)) == brute_removed(rows)


def test_substring_dedup_odd_rows(spark, repeated_texts):
    text = max((t for t in repeated_texts if t), key=len)
    df = spark.createDataFrame([(2, text, 1, "k"), (2, text, 1, "k"), (None, text, 1, "k"), (5, None, 1, "k")], SCHEMA)
    found = digests(df)
    n = len(text.encode())
    own = brute_removed([(0, text)])[0][2]  # what repeats within the text itself
    assert sorted((r[0], r[2]) for r in found if r[0]) == [(2, n), (2, n), (5, 0)]
    assert [r[2] for r in found if r[0] is None] == [own]
    assert digests(df.where("false")) == []


def test_suffix_order():
    rng = np.random.default_rng(3)
    for alphabet in (2, 4, 200):
        data = rng.integers(0, alphabet, 3000).astype(np.uint8)
        data[500:800] = data[100:400]
        start = rng.integers(0, 2900, 700)
        hashes = PrefixHash(data, 1)
        order = suffix_order(data, hashes, start, 90)
        keys = [bytes(data[s : s + 90]) for s in start]
        assert order.tolist() == sorted(range(700), key=lambda i: (keys[i], i))
        group = classes(data, hashes, start, 90)
        assert all((group[i] == group[0]) == (keys[i] == keys[0]) for i in range(700)) and len(set(group)) == len(set(keys))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages, now = dict(C.STAGES), docs
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "source_mixing", "sentencepiece"]
    for n, (name, stage) in enumerate(C.STAGES):
        path = str(tmp_path / name)
        stage(spark, now, "/root/testdata/sf0.001").write.parquet(path)
        before, now = now, spark.read.parquet(path)
        if n < 4:
            assert now.columns == C.COLUMNS and now.select("doc_id").join(before, "doc_id", "left_anti").count() == 0
        if name == "exact_dedup":
            assert now.count() == before.select(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).distinct().count()
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in now.collect()} == set(brute_components(rows, 5).values())
    whole = C.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, whole.collect())) == sorted(map(str, now.collect()))


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline as C

    rows = [(1, "the cat and the dog", "en", "s", 3), (None, "the cat and the dog", "en", None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (4, "der Hund und die Katze", None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(False))
    for now in (df, df.where("false")):
        for _, stage in C.STAGES:
            now = stage(spark, now, "")
            now.count()


def _thue_morse(levels: int) -> tuple[str, str]:
    """Two strings whose polynomials agree modulo every power of two up to a size that grows with the levels."""
    a, b = "a", "b"
    for _ in range(levels):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("seed", [1, 2])
def test_hashes_tell_structured_texts_apart(seed):
    for levels in (6, 7, 8, 10, 12):
        a, b = (np.frombuffer(t.encode(), np.uint8) for t in _thue_morse(levels))
        hashes = PrefixHash(np.concatenate((a, b)), seed)
        one, two = hashes.of(np.array([0, len(a)]), len(a)).tolist()
        assert (one ^ two) & 0xFFFF


def test_hashes_are_polynomials_modulo_the_prime():
    data = np.random.default_rng(3).integers(0, 256, 150_000).astype(np.uint8)  # over two chunks
    hashes, whole = PrefixHash(data, 1), PrefixHash(data[70_000:], 1)
    assert (hashes.every(40) == hashes.of(np.arange(len(data) - 39), 40)).all()
    assert (hashes.every(40)[70_000:] == whole.every(40)).all()
    values, base, prime = *suffix_sort._tables(1), 2**61 - 1
    plain = 0
    for i, byte in enumerate(data[:3000].tolist()):
        plain = (plain + int(values[byte]) * pow(base, i, prime)) % prime
    assert plain == int(hashes.prefix[3000])


def test_substring_dedup_of_structured_texts(spark):
    a, b = _thue_morse(9)
    rows = [(1, a), (2, b), (3, a + b), (4, "x" + b[:150] + a[:150])]
    assert digests(spark.createDataFrame([(i, t, 1, "k") for i, t in rows], SCHEMA)) == brute_removed(rows)
