import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vecloom.llm import bits, near_copies, simhash


def brute_fingerprint(text, n):
    words = simhash.FIND("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    found = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def brute_components(rows, most):
    """Smallest id reachable, by id of (id, fingerprint)."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if bin(a ^ b).count("1") <= most:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in rows}


def test_fingerprints(odd_rows):
    lists = [simhash.shingle_hashes(t, 4) for _, t in odd_rows]
    assert bits.fingerprints_of(lists, 1)[:, 0].tolist() == [brute_fingerprint(t, 4) for _, t in odd_rows]
    assert bits.fingerprints_of([], 2).shape == (0, 2)
    assert simhash.shingle_hashes("A b C d", 4).tolist() == [xxhash.xxh64_intdigest(b"a b c d", 42)]


def test_rows(spark, odd, odd_rows, nothing):
    got = simhash.near_duplicate_ids(odd).collect()
    assert Counter((r["doc_id"], int(r["fingerprint"], 16)) for r in got) == Counter((i, brute_fingerprint(t, 4)) for i, t in odd_rows)
    rows = [(i, brute_fingerprint(t, 4)) for i, t in odd_rows if i not in (None, 311)]
    want = brute_components(rows, 4)
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] not in (None, 311))
    assert {r["component_id"] for r in got if r["doc_id"] in (300, 301, 302, 303)} == {300}
    assert simhash.near_duplicate_ids(nothing).count() == 0


@pytest.mark.parametrize("small", [2, 32])
def test_chains_and_large_groups(spark, small, monkeypatch):
    monkeypatch.setattr(bits, "SMALL", small)
    rnd = random.Random(5)
    found = []
    for _ in range(12):
        c = rnd.getrandbits(64)
        for _ in range(40):
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                c ^= 1 << b
            found.append(c)
    centre = rnd.getrandbits(64)
    found += [centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(200)]
    found = sorted(set(found), key=lambda x: rnd.random())
    signed = np.array(found, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(signed, range(len(found)))), "fp long, id long").repartition(3)
    got = {r["node"]: r["component"] for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components(list(enumerate(found)), 4)
    assert {i: got.get(i, i) for i in want} == want


def test_group_links_span_every_group():
    rnd = np.random.default_rng(6)
    keys = np.sort(rnd.integers(0, 30, 600))
    fps = (rnd.integers(0, 2**8, (600, 1)) | 0).astype(np.uint64)
    a, b = simhash.group_links(keys, fps, 1)
    assert (keys[a] == keys[b]).all() and bits.close(fps[a], fps[b], 1).all()
    for key in range(30):
        at = np.flatnonzero(keys == key).tolist()
        want = brute_components([(i, int(fps[i, 0])) for i in at], 1)
        got = brute_components([(i, 0) for i in at], -1)
        for x, y in zip(a.tolist(), b.tolist()):
            if keys[x] == key:
                low, high = sorted((got[x], got[y]))
                got = {i: low if c == high else c for i, c in got.items()}
        assert got == want


def jaccard_pairs(texts, least):
    """(a, b, similarity) of texts whose sets of five-word shingles have at least so much, by an inverted index."""
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    holders, common = {}, Counter()
    for i, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    for own in holders.values():
        common.update((a, b) for k, b in enumerate(own) for a in own[:k])
    found = ((a, b, n / (len(sets[a]) + len(sets[b]) - n)) for (a, b), n in common.items())
    return [f for f in found if f[2] >= least]


def test_recall_on_given_documents(spark):
    """Nine of ten pairs of 0.8 or more share a component, as do none that no chain of such pairs connects."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.filter("text is not null").collect()}
    pairs = jaccard_pairs(texts, 0.8)
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), "text")
    got = {r["id"]: r["component"] for r in near_copies.near_copies(rows, lambda t: simhash.shingle_hashes(t, 5), 0.8).collect()}
    hit = [got[a] == got[b] for a, b, _ in pairs]
    low = [got[a] == got[b] for a, b, s in pairs if s < 0.9]
    print("RECALL", len(hit), sum(hit), len(low), sum(low))
    assert len(hit) > 50 and np.mean(hit) >= 0.95 and (not low or np.mean(low) >= 0.9)
    root = {i: i for i in got}
    for a, b, _ in pairs:
        x, y = sorted((root[a], root[b]))
        root = {i: x if r == y else r for i, r in root.items()} if x != y else root
    assert all(root[i] == root[c] for i, c in got.items() if texts.get(i) and simhash.FIND(texts[i]))


def test_one_of_each_group_stays(spark, odd, nothing):
    kept = simhash.without_copies(odd)
    assert kept.columns == odd.columns
    n = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert n[3] == 1 and n[200] == n[201] == 0 and n[203] == n[304] == 1
    twice = odd.filter("doc_id = 203").union(odd.filter("doc_id = 203"))
    assert simhash.without_copies(twice).count() == 1
    assert simhash.without_copies(nothing).count() == 0
    assert kept.filter(F.col("doc_id") == 0).count() == 1


def test_pairs_within_the_bound_share_a_key():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a = rng.integers(0, 2**63, 1).astype(np.uint64)
        b = a.copy()
        for bit in rng.permutation(64)[:4]:
            b ^= np.uint64(1) << np.uint64(bit)
        keys = [{int(k[0]) for k in simhash.variant_keys(x)} for x in (a, b)]
        assert len(keys[0]) == 64 and keys[0] & keys[1]
    with pytest.raises(ValueError):
        simhash.links(None, 5)


def test_links_are_those_of_exact_jaccard(spark):
    """Pairs all around 0.8: those that reach it lose the larger id, those below keep both, and chains are whole."""
    rnd = random.Random(12)
    rows, n = [], 0
    for _ in range(80):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(40, 200))]
        for _ in range(rnd.randint(2, 4)):
            rows.append((n, " ".join(words)))
            n += 1
            words = list(words)
            for _ in range(max(1, round(len(words) * rnd.uniform(0.01, 0.035)))):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    rnd.shuffle(rows)
    sets = [(i, set(simhash.shingle_hashes(t, 5).tolist())) for i, t in rows]
    root = {i: i for i, _ in sets}
    near = below = 0
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            jaccard = len(a & b) / len(a | b)
            near, below = near + (0.8 <= jaccard < 0.9), below + (0.65 <= jaccard < 0.8)
            if jaccard >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {x: low if r == high else r for x, r in root.items()}
    assert near > 30 and below > 30
    kept = {r["doc_id"] for r in simhash.without_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = {i for i, r in root.items() if i == r}
    # Verified exactly, so nothing else goes; of those that should, a chance of some hundredths to stay.
    assert want <= kept and len(kept - want) <= 0.08 * (len(rows) - len(want))


def test_sizes_and_parities_put_no_similar_pair_aside():
    rng = np.random.default_rng(3)
    kept = {True: [], False: []}
    for size in (1, 2, 9, 40, 100, 300, 5000):
        for share in (0.0, 0.05, 0.1, 0.11, 0.12, 0.25, 0.5):
            for _ in range(10):
                a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                b = np.union1d(a[int(share * size / 2) :], rng.integers(0, 2**63, int(share * size / 2)).astype(np.uint64))
                if not b.size:
                    continue
                jaccard = np.intersect1d(a, b).size / np.union1d(a, b).size
                n = [np.array([len(s)]) for s in (a, b)]
                fits = near_copies.may_fit(*n, near_copies.parities(a)[None], near_copies.parities(b)[None], 0.8)[0]
                kept[bool(jaccard >= 0.8)].append(bool(fits))
    assert all(kept[True]) and len(kept[True]) > 100
    assert sum(kept[False]) < len(kept[False])
    # A pair at the bound itself, all of it in bins of its own: 4 of 5 shared.
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert near_copies.may_fit(np.array([9]), np.array([9]), near_copies.parities(a)[None], near_copies.parities(b)[None], 0.8)[0]


def test_segments_and_halves_find_near_fingerprints():
    """Two fingerprints share a variant just where a segment of theirs differs in at most one bit."""
    rng = np.random.default_rng(13)
    assert near_copies.miss_chance(0.8) < 0.06 and near_copies.miss_chance(0.85) < 0.02 and near_copies.bits_apart(0.8) == 64
    for _ in range(60):
        a = rng.integers(0, 2**63, (1, near_copies.TABLES)).astype(np.uint64)
        b = a.copy()
        for bit in rng.permutation(320)[: rng.integers(10, 90)]:
            b[0, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        keys, apart = [], []
        for fps in (a, b):
            own = [*near_copies._segments(fps)]
            route = np.concatenate([(v >> np.uint64(10 * h) & np.uint64(1023)) + np.uint64((2 * s + h) << 10) for s, v in enumerate(own) for h in (0, 1)]).astype(np.uint32)
            keys.append({(i, int(x)) for i, k in enumerate(near_copies._variants(route, np.repeat(fps, len(route), axis=0))) for x in k})
            apart.append(own)
        least = min(int(np.bitwise_count(x ^ y)[0]) for x, y in zip(*apart))
        assert bool(keys[0] & keys[1]) == (least <= 1)


def test_members_apart():
    """All near pairs of different labels in a group, in small and in large ones."""
    rng = np.random.default_rng(14)
    keys = np.sort(rng.choice([0, 0, 0, 1, 2, 3, 4, 5], 160))
    order = rng.permutation(160)
    fps, labels = rng.integers(0, 2**7, (160, 1)).astype(np.uint64), rng.choice([0, 0, 0, 0, 1, 2], 160)
    x, y = near_copies._apart(keys, fps, labels, order, 2)
    got = {frozenset(p) for p in zip(x.tolist(), y.tolist())}
    want = {frozenset((int(order[i]), int(order[j]))) for i in range(160) for j in range(i) if keys[i] == keys[j] and labels[order[i]] != labels[order[j]] and bits.close(fps[order[i]][None], fps[order[j]], 2)[0]}
    assert got == want and len(got) > 20


def test_repeated_rows_and_null_ids(spark):
    """Rows without an id all stay, whether or not some other id repeats; names don't matter."""
    text = " ".join(f"w{x}" for x in range(40))
    none = [(None, text, 1, "a"), (None, text, 1, "a")]
    schema = "doc_id long, text string, t int, row string"
    assert simhash.without_copies(spark.createDataFrame([*none, (7, "b c", 1, "a")], schema)).count() == 3
    again = [*none, (7, "b c", 1, "x"), (7, "b c", 1, "y"), (7, "b c", 1, "y"), (8, text, 1, "a"), (9, text, 2, "a")]
    runs = [sorted(map(str, simhash.without_copies(spark.createDataFrame(rows, schema).repartition(3)).collect())) for rows in (again, again[::-1])]
    assert runs[0] == runs[1] and len(runs[0]) == 4


def test_rows_of_one_id_go_one_by_one(spark):
    texts = [" ".join(f"{c}{x}" for x in range(50)) for c in "ab"]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[0]), (2, texts[1])], "doc_id long, text string")
    assert {tuple(r) for r in simhash.without_copies(docs).collect()} == {(1, texts[0]), (2, texts[1])}


def test_a_pair_counts_in_one_variant_that_it_shares():
    rng = np.random.default_rng(17)
    for flips in (0, 1, 5, 30, 60, 150):
        a = rng.integers(0, 2**63, (1, near_copies.TABLES)).astype(np.uint64)
        b = a.copy()
        for at in rng.choice(near_copies.TABLES * 64, flips, replace=False).tolist():
            b[0, at // 64] ^= np.uint64(1) << np.uint64(at % 64)
        shared = []
        values = [[int(v[0]) for v in near_copies._segments(fps)] for fps in (a, b)]
        for s, (x, y) in enumerate(zip(*values)):
            for half in (0, 1):
                unlike = ((x ^ y) & 1023, (x ^ y) >> 10)
                shared += [(s, half, bit) for bit in range(10) if not unlike[half] and not unlike[1 - half] & ~(1 << bit)]
        got = tuple(int(c[0]) for c in near_copies.first_shared(a ^ b))
        assert got == shared[0] if shared else got[0] == -1


def test_forests_connect_all_candidates_and_send_each_pair_once(spark):
    """A large group of near fingerprints, and pairs beside it, against all pairs."""
    rng = np.random.default_rng(19)
    heads = rng.integers(0, 2**63, (40, near_copies.TABLES)).astype(np.uint64)
    fps = np.repeat(heads, [120] + [3] * 39, axis=0)
    for row in fps:
        for at in rng.choice(near_copies.TABLES * 64, 12, replace=False).tolist():
            row[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    rows = [(i, 10, i % 5, *f.view(np.int64).tolist(), *[0] * len(near_copies.ODD)) for i, f in enumerate(fps)]
    nodes = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ["node", "n", "label", *near_copies.WORDS]))
    most = near_copies.bits_apart(0.8)
    want = set()
    for i in range(len(fps)):
        near = np.flatnonzero(bits.close(fps[i + 1 :], fps[i], most)) + i + 1
        if near.size:
            segment, _, _ = near_copies.first_shared(fps[near] ^ fps[i])
            want |= {(i, int(j)) for j in near[segment >= 0]}
    assert len(want) > 1000
    found = [(r["a"], r["b"]) for r in near_copies._met(nodes, 0.8, apart=True).collect()]
    assert len(found) == len({*found}) and {*found} == {(a, b) for a, b in want if a % 5 != b % 5}
    found = [(r["a"], r["b"]) for r in near_copies._met(nodes, 0.8, apart=False).collect()]
    assert len(found) == len({*found}) and {*found} <= want and len(found) < len(want) / 2

    def groups(pairs):
        parent = list(range(len(fps)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return [root(i) for i in range(len(fps))]

    assert groups(found) == groups(want)
