import numpy as np
import pytest
import xxhash

from kelpline.llm import simhash


def plain_fingerprint(text, words=3):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    shingles = [b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def plain_components(fps, ids, distance=2):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for r, i in zip(root, ids, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in root]


def test_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("one two three", 42) == simhash.fingerprint_of("One TWO three")


def test_near_duplicates_of_odd_rows(documents, odd_rows):
    out = simhash.near_duplicates(documents(odd_rows)).toPandas()
    fps = [plain_fingerprint(t) for _, t, _ in odd_rows]
    want = sorted(((i or -1), format(f, "016x"), (-1 if c is None else c)) for (i, _, _), f, c in zip(odd_rows, fps, plain_components(fps, [i for i, _, _ in odd_rows]), strict=True))
    got = sorted((int(i) if i == i else -1, f, int(c) if c == c else -1) for i, f, c in out.itertuples(index=False))
    assert got == want


@pytest.mark.parametrize(("distance", "parts", "bucket"), [(2, (3,), 2048), (2, (3,), 4), (6, (4, 7), 2048), (6, (4, 7), 8), (0, (1,), 4), (1, (2,), 4)])
def test_links_span_the_components(spark, distance, parts, bucket):
    rng = np.random.default_rng(distance)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, dtype=np.uint64) for _ in range(600)]
    own = set(centres.tolist())
    for f in flips:  # chains that wander off a few centres
        own.add(int(np.uint64(rng.choice(sorted(own)[-40:])) ^ f))
    fps = sorted(own)
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    labels = {r[0]: r[1] for r in simhash.components(simhash.links(df, distance, parts, bucket)).collect()}
    want = plain_components(fps, list(range(len(fps))), distance)
    groups = {}
    for k, (s,) in enumerate(signed):
        groups.setdefault(labels.get(s, ("alone", s)), set()).add(k)
    expected = {}
    for k, c in enumerate(want):
        expected.setdefault(c, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_allocation_is_a_pigeonhole():
    costs = [[5.0, 50.0, 500.0], [1.0, 2.0, 300.0], [1000.0, 2000.0, 3000.0]]
    thresholds = simhash.allocate(costs, 2)
    assert sum(t + 1 for t in thresholds) == 3
    assert thresholds == [0, 1, -1]
    masks = simhash.probes([[0, 1], [2, 3, 4], [5]], thresholds)
    assert len(masks) == 1 + 3


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = dict(simhash.components(edges).collect())
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000


def test_empty(documents):
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.deduplicate(documents([])).count() == 0


def test_deduplicate_keeps_one_of_each_group(documents, odd_rows):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    near = list(base)
    near[100] = "other"
    far = [f"v{k}" for k in rng.integers(0, 5000, 400)]
    rows = [*odd_rows, (20, " ".join(base), "a"), (21, " ".join(near), "b"), (22, " ".join(far), "a"), (23, " ".join(base).upper(), "a")]
    docs = documents(rows)
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    kept = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in out.collect())
    # 1, 2 and 2 are equal; 3, 4, 5 and the null text have no words; 8 and 9 differ in case only
    assert kept == sorted([1, 3, 6, -1, 7, 8, 20, 22])


def plain_similarity(a, b, words=5):
    one, two = ({" ".join(t[i : i + words]) for i in range(max(1, len(t) - words + 1))} for t in (a, b))
    return len(one & two) / len(one | two)


def edited(rng, groups):
    """Texts with scattered and contiguous edits, in a random order."""
    fresh = lambda n: [f"w{k}" for k in rng.integers(0, 3000, n)]
    line, own = fresh(12), []
    for k in range(groups):
        base = fresh(int(rng.integers(6, 300))) + line * (k % 2)
        n = len(base)
        swapped = list(base)
        swapped[n // 2] = "other"
        own += [base, base[: int(0.86 * n)], base + fresh(int(0.15 * n)), base[: int(0.93 * n)] + fresh(int(0.05 * n)), fresh(int(0.12 * n)) + base, swapped]
    rng.shuffle(own := [tuple(t) for t in own])
    return own


def check_kept(own, kept):
    """No two that stay are near copies; each that goes is one of another that stays or went."""
    same = lambda i, j: plain_similarity(own[i], own[j]) >= 0.8
    assert not [(i, j) for i in kept for j in kept if i < j and same(i, j)]
    reached, open_ = set(kept), set(range(len(own))) - set(kept)
    while more := {i for i in open_ if any(same(i, j) for j in reached)}:
        reached, open_ = reached | more, open_ - more
    assert not open_


@pytest.mark.parametrize("limits", [{}, {"MEMBERS": 2}, {"SHINGLES": 150}, {"BUCKET": 4}, {"MEMBERS": 2, "BUCKET": 3, "SHRUNK": 0.0}])
def test_near_copies_against_brute_force(documents, monkeypatch, limits):
    """Also where components, texts and buckets are over the limits of a task, and where rounds don't shrink them."""
    rng = np.random.default_rng(11)
    for name, value in ({"SAMPLE": 40} | limits).items():
        monkeypatch.setattr(simhash, name, value)
    own = edited(rng, 24)
    out = simhash.deduplicate(documents([(k, " ".join(t), "s") for k, t in enumerate(own)]))
    kept = sorted(r["doc_id"] for r in out.collect())
    check_kept(own, kept)
    assert len(kept) < 90


def test_a_large_group_of_near_copies(documents, monkeypatch):
    """One group of near copies beyond every limit leaves one document."""
    for name, value in (("MEMBERS", 8), ("BUCKET", 16)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 4000, 300)]
    own = []
    for k in range(150):
        t = list(base)
        t[int(rng.integers(0, 300))] = f"x{k}"
        own.append(tuple(t[: 300 - int(rng.integers(0, 12))]))
    other = [tuple(f"v{j}" for j in rng.integers(0, 4000, 50)) for _ in range(20)]
    docs = documents([(k, " ".join(t), "s") for k, t in enumerate(own + other)])
    kept = {r["doc_id"] for r in simhash.deduplicate(docs).collect()}
    assert len(kept & set(range(150))) == 1 and kept >= set(range(150, 170))


@pytest.mark.parametrize("bucket", [2048, 4])
def test_prefix_links_span_every_pair(spark, documents, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 900, 120)]
    own = [base[a : 120 - b] for a in range(0, 40, 4) for b in range(0, 40, 4)]
    unique = simhash.distinct_texts(documents([(k, " ".join(t), "s") for k, t in enumerate(own)]))
    items = simhash.materialise(simhash.sketched(unique, 0.8, 5))
    ids = {r["first"]: r["id"] for r in items.collect()}
    links, large = simhash.bucket_links(simhash.prefix_keys(items), simhash.parity_near(0.8))
    assert large == (bucket == 4)
    label = dict(simhash.components(links).collect())
    near = [(i, j) for i in ids for j in ids if i < j and plain_similarity(own[i], own[j]) >= 0.8]
    assert near and all(label[ids[i]] == label[ids[j]] for i, j in near)
    monkeypatch.setattr(simhash, "BUCKET", 2048)
    space = simhash.Workspace(spark)
    pairs = {tuple(sorted(r)) for r in simhash.checked_pairs(space, unique, items, simhash.parity_near(0.8), 0.8, 5).collect()}
    assert pairs == {tuple(sorted((ids[i], ids[j]))) for i, j in near}
    space.drop()


@pytest.mark.parametrize("limits", [{}, {"PARITY": 64}])
def test_parities_tell_long_texts_apart(monkeypatch, limits):
    """Texts of many more shingles than bits were all near: every pair of long texts with a common shingle was checked."""
    import pyarrow as pa

    for name, value in limits.items():
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(7)
    sets = []
    for n in (40, 900, 1020, 1100, 2100, 2500, 4000, 9000, 30_000):
        base = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        sets += [base, base[: int(0.81 * n)], np.unique(np.concatenate([base[: int(0.92 * n)], rng.integers(-(1 << 62), 1 << 62, n // 10)]))]
    sets.append(np.concatenate([sets[-3][:100], np.unique(rng.integers(1 << 62, (1 << 63) - 1, 29_000))]))
    items = pa.StructArray.from_arrays([pa.array(range(len(sets))), pa.array([len(x) for x in sets]), pa.array([simhash.parities(x) for x in sets], pa.binary())], names=["id", "n", "bits"])
    near, every = simhash.parity_near(0.8)(items), np.arange(len(sets))
    for i in every:
        same = np.array([len(np.intersect1d(x, sets[i])) for x in sets])
        alike = same / (np.array([len(x) for x in sets]) + len(sets[i]) - same)
        found = near(i, every)
        assert found[alike >= 0.8].all() and not found[alike < 0.2].any()


def test_dominated_leaves_a_maximal_independent_set(spark):
    rng = np.random.default_rng(4)
    pairs = {tuple(sorted(map(int, rng.integers(0, 200, 2)))) for _ in range(400)} | {(k, k + 1) for k in range(1000, 1200)}
    pairs = {(a, b) for a, b in pairs if a != b}
    space = simhash.Workspace(spark)
    gone = {r[0] for r in simhash.dominated(space, spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    space.drop()
    stay = {x for p in pairs for x in p} - gone
    assert not [(a, b) for a, b in pairs if a in stay and b in stay]
    assert all(any((a in stay and b == g) or (b in stay and a == g) for a, b in pairs) for g in gone)


def test_rows_without_an_id_and_equal_texts(documents):
    rows = [(None, "same words in this text here", "a")] * 30 + [(i, "same words in this text here", "b") for i in range(30)] + [(None, "another text of some six words", None)] * 3
    out = simhash.deduplicate(documents(rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == [(False, 0), (True, 0)]
