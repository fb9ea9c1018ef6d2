import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vecloom.llm import passages, substrings, suffix_dedup
from vecloom.llm.simhash import FIND

FAR = 1 << 62


def brute_words(rows, size):
    least = {}
    for i, t in rows:
        w = FIND(t or "")
        for s in range(len(w) - size + 1):
            g = tuple(w[s : s + size])
            least[g] = min(least.get(g, FAR), FAR if i is None else i)
    out = []
    for i, t in rows:
        w = FIND(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if least[tuple(w[s : s + size])] < (FAR if i is None else i):
                gone[s : s + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_bytes(rows, size):
    raws = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(b[s : s + size] for _, b in raws for s in range(len(b) - size + 1))
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if n[b[s : s + size]] > 1:
                gone[s : s + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return out


def same(df, want):
    assert Counter(map(tuple, df.collect())) == Counter(want)


def spliced(seed, n=50):
    rnd = random.Random(seed)
    base = [" ".join("".join(rnd.choices("abcdé", k=rnd.randint(1, 6))) for _ in range(300)) for _ in range(3)]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rnd.randint(0, 4)):
            b = rnd.choice(base)
            s = rnd.randint(0, len(b))
            text += b[s : s + rnd.randint(0, 700)] + rnd.choice([" ", "\n", "", "x ", "é"])
        rows.append((i * 7 % 53, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_spliced_texts(spark, seed):
    rows = spliced(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(substrings.remove(docs, keep_text=False), brute_words(rows, 13))
    same(suffix_dedup.remove(docs, keep_bytes=False), brute_bytes(rows, 200))


def test_odd_rows(spark, odd, odd_rows):
    rows = [r for r in odd_rows if r[0] != 203]
    docs = odd.filter("doc_id is null or doc_id <> 203")
    same(substrings.remove(docs.select("doc_id", "text"), keep_text=False), brute_words(rows, 13))
    out = substrings.remove(docs)
    assert out.columns == [c for c in odd.columns if c != "text"] + ["n_words", "n_removed", "kept_sha256", "__kept"]
    clash = docs.selectExpr("doc_id", "text", "1 AS n_words", "2 AS rest")
    assert substrings.remove(clash).columns == ["doc_id", "n_words", "rest", "__n_words", "n_removed", "kept_sha256", "__kept"]
    same(suffix_dedup.remove(docs, keep_bytes=False), brute_bytes(rows, 200))


def test_long_text_against_slices(spark, odd, odd_rows, monkeypatch):
    """One text above the size of a slice, and slices of single rows."""
    monkeypatch.setattr(passages, "SLICE", 1000)
    rows = [(i, t) for i, t in odd_rows if i is None or i < 100 or i in (203, 310)]
    docs = odd.filter("doc_id is null or doc_id < 100 or doc_id in (203, 310)").select("doc_id", "text")
    same(substrings.remove(docs, keep_text=False), brute_words(rows, 13))


def test_kept_text_and_spans(spark):
    a = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (2, f"new  words\n{a} at the end"), (3, "as  it\nwas")], "doc_id long, text string")
    kept = {r["doc_id"]: r["__kept"] for r in substrings.remove(docs).collect()}
    assert kept == {1: a, 2: "new words at the end", 3: "as  it\nwas"}
    b = "".join(random.Random(1).choices("abcdefgh", k=300))
    rows = {r["doc_id"]: r for r in suffix_dedup.remove(spark.createDataFrame([(1, b), (2, f"x{b}y")], "doc_id long, text string")).collect()}
    assert [tuple(s) for s in rows[2]["spans"]] == [(1, 301)] and bytes(rows[2]["kept"]) == b"xy" and bytes(rows[1]["kept"]) == b""


def test_empty(spark, nothing):
    assert substrings.remove(nothing).count() == 0 and suffix_dedup.remove(nothing).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r["n_removed"] for r in substrings.remove(none).collect()] == [0, 0] and [r["n_spans"] for r in suffix_dedup.remove(none).collect()] == [0, 0]


def test_automaton_is_matching_statistics():
    rnd = random.Random(3)
    for _ in range(60):
        texts = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(0, 12))] for _ in range(rnd.randint(0, 4))]
        shard = substrings.Automaton()
        for t in texts:
            shard.add(t)
        words = [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(15)]
        has = lambda x: any(t[i : i + len(x)] == x for t in texts for i in range(len(t) - len(x) + 1))
        want = [max(n for n in range(i + 2) if not n or has(words[i + 1 - n : i + 1])) for i in range(15)]
        assert shard.matches(words) == want
    assert substrings.spans([0, 1, 2, 3, 1, 2, 3, 0, 3], 3) == [(1, 7), (6, 9)] or substrings.spans([0, 1, 2, 3, 1, 2, 3, 0, 3], 3) == [(1, 9)]


@pytest.mark.parametrize("side", [1, -1])
@pytest.mark.parametrize("blind", [False, True])
def test_suffix_sort(side, blind, monkeypatch):
    """Against Python's sort, also where every hash collides and the bytes must decide."""
    if blind:
        monkeypatch.setattr(suffix_dedup.Suffixes, "hashes", lambda self, i, n, side: np.zeros(len(i), np.uint64))
    rnd = random.Random(4)
    strings = [bytes(rnd.choices(b"ab", k=rnd.randint(3, 30))) for _ in range(120)]
    groups = np.sort(np.array([rnd.choice([0, 1, 2, 2, 2, 9]) for _ in strings]))
    anchors = np.array([rnd.randint(0, len(s)) for s in strings])
    s = suffix_dedup.Suffixes(strings, anchors)
    order, extensions = s.classes(groups, side)
    text = lambda i: strings[i][anchors[i] :] if side > 0 else strings[i][: anchors[i]][::-1]
    assert [(groups[i], text(i)) for i in order] == sorted((g, text(i)) for i, g in enumerate(groups))
    for k in range(1, len(order)):
        a, b = text(order[k - 1]), text(order[k])
        n = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
        assert extensions[k] == (n if groups[order[k - 1]] == groups[order[k]] else -1)


def test_anchors_depend_on_windows_only():
    import pyarrow as pa

    rnd = random.Random(5)
    shared = " ".join(rnd.choices(["ab", "cd", "ef", "g", "hij"], k=60))
    texts = passages.Texts(pa.array([shared, "x " + shared, None, "", "y z " + shared + " q"]))
    for unit, size, gram in ((passages.Words, 13, 6), (passages.Bytes, 50, 16)):
        units = unit(texts)
        a = passages.Anchors(units, size, gram)
        found = {}
        for t in (0, 1, 4):
            own = a.text == t
            found[t] = {int(h) for h in a.hash[own]}
        assert found[0] <= found[1] & found[4]
        assert (a.place >= a.last).all() and (a.place - a.first <= size - gram).all()
        n = np.diff(units.bounds)
        assert sum((a.last - a.first + 1).tolist()) == sum(max(0, x - size + 1) for x in n.tolist())


def test_packing():
    columns = [np.arange(-5, 70_000), np.zeros(0, np.uint64), np.arange(9, dtype="<u4"), np.frombuffer(b"bytes", np.uint8)]
    back = passages.unpack(passages.pack(columns), ["<i8", "<u8", "<u4", np.uint8])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(columns, back))


@pytest.mark.parametrize("seed", [3, 4])
def test_frequent_anchors_are_dealt_by_window(spark, seed, monkeypatch):
    monkeypatch.setattr(passages, "LEAST_HOT", 2)
    rows = spliced(seed, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    keyed = passages.keyed(docs, "doc_id", "text")
    _, hot = passages.shared(keyed, passages.Words, 13, 6, passages.hot_from(keyed))
    assert hot.size > 100
    same(substrings.remove(docs, keep_text=False), brute_words(rows, 13))


def test_covered_context_with_new_windows(spark):
    """Document 3 is covered by windows of 1 and 2, but has the first of the window that is all of 4."""
    import pyarrow as pa

    for seed in range(1000):
        w = [f"w{x}" for x in random.Random(seed).sample(range(10**6), 20)]
        found = passages.Anchors(passages.Words(passages.Texts(pa.array([" ".join(w)]))), 13, 6)
        if found.place.tolist() == [7]:
            break
    rows = [(i, " ".join(w[a:b])) for i, a, b in ((1, 0, 13), (2, 7, 20), (3, 0, 20), (4, 3, 16))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.remove(docs).collect()} == {1: 0, 2: 0, 3: 20, 4: 13}
    same(substrings.remove(docs, keep_text=False), brute_words(rows, 13))


def test_greatest_id_beside_null_ids(spark):
    """A text of id 2**63 - 1 and one without an id share neither spans nor an identity."""
    rnd = random.Random(21)
    a, b, c = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    top = (1 << 63) - 1
    rows = [(1, a), (top, f"{a} {b}"), (None, c), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {w[3] for w in brute_words([(1, a), (1 << 61, f"{a} {b}"), (None, c), (None, b)], 13)}
    got = substrings.remove(docs, keep_text=False).collect()
    assert {r["kept_sha256"] for r in got} == want and {(r["doc_id"], r["n_removed"]) for r in got} == {(1, 0), (top, 60), (None, 0), (None, 60)}
    same(suffix_dedup.remove(docs, keep_bytes=False), brute_bytes(rows, 200))
    for pair in ([(top, a), (None, b)], [(None, a), (top, f"{a} {b}")]):
        docs = spark.createDataFrame(pair, "doc_id long, text string")
        removed = {r["doc_id"]: r["n_removed"] for r in substrings.remove(docs).collect()}
        assert removed == {top: 0, None: 60 if pair[0][0] is None else 0}
        same(suffix_dedup.remove(docs, keep_bytes=False), brute_bytes(pair, 200))


@pytest.mark.parametrize("module", ["sort", "automaton"])
def test_nothing_goes_without_the_method(module, monkeypatch):
    """Every removed byte or word is found by the suffix sort or by an automaton; equality only thins out what they get."""
    if module == "sort":
        monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda strings, *more: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        resolve = suffix_dedup._resolve(200)
    else:
        monkeypatch.setattr(substrings.Automaton, "matches", lambda self, words: [0] * len(words))
        resolve = substrings._resolve(13)
    contexts = [b"a b c d e f g h i j k l m n o " * 20] * 4
    args = np.zeros(4, np.uint64), contexts, np.full(4, 100), np.full(4, 60), np.arange(4), np.zeros(4, np.uint8)
    assert not [*resolve(*args)]
    monkeypatch.undo()
    assert [*(suffix_dedup._resolve(200) if module == "sort" else substrings._resolve(13))(*args)]
