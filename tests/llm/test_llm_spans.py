import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from test_llm_near import folded_pair
from eigenloom.llm.column_bwt import ABSENT, range_minima, remove_repeats, repeated_windows
from eigenloom.llm.debruijn_spans import remove_repeated_words

from odd_rows import ODD


def plain_bytes(rows, width):
    """(id, bytes, kept, number of spans) of every row, by looking every window up."""
    key = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, t in rows:
        t = (t or "").encode()
        for s in range(len(t) - width + 1):
            w = t[s : s + width]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - width + 1):
            if first[t[s : s + width]] < key(i):
                gone[s : s + width] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(t), bytes(np.frombuffer(t, np.uint8)[~gone]), spans))
    return sorted(out, key=str)


def found_bytes(df, width):
    rows = remove_repeats(df, width=width).collect()
    return sorted(((r.doc_id, r.n_bytes, bytes(r.kept), len(r.removed)) for r in rows), key=str)


def plain_words(rows, width):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    count = Counter(tuple(w[s : s + width]) for _, w in split for s in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if count[tuple(w[s : s + width])] > 1:
                gone[s : s + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def found_words(df, width):
    rows = [tuple(r) for r in remove_repeated_words(df, width=width).collect()]
    digests = remove_repeated_words(df, width=width, digest=True).collect()
    wanted = sorted((str(r[0]), r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows)
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in digests) == wanted
    return sorted(rows, key=str)


def shared_texts(seed, alphabet, sep, n=60):
    rng = random.Random(seed)
    passages = [[rng.choice(alphabet) for _ in range(rng.randrange(20, 160))] for _ in range(6)]
    rows = []
    for k in range(n):
        text = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += rng.choice([p, p[a:], p[:a], [rng.choice(alphabet) for _ in range(30)]])
        rows.append((k, sep.join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij", "aéß日"])
def test_bytes(table, alphabet):
    rows = shared_texts(1, alphabet, "")
    assert found_bytes(table(rows), 50) == plain_bytes(rows, 50)


def test_bytes_odd_rows(odd):
    assert found_bytes(odd, 50) == plain_bytes(ODD, 50)


def test_bytes_hot_passage(table):
    rows = [(k, f"{k} " * 20 + "one passage that a third of all documents share, word for word, to the end" * (k % 3 == 0)) for k in range(600)]
    assert found_bytes(table(rows, parts=8), 50) == plain_bytes(rows, 50)


@pytest.mark.parametrize("alphabet", [["a", "b"], [f"w{k}" for k in range(30)]])
@pytest.mark.parametrize("width", [35, 12])
def test_words(table, alphabet, width):
    rows = shared_texts(2, alphabet, " ")
    assert found_words(table(rows), width) == plain_words(rows, width)


def test_words_odd_rows(odd):
    assert found_words(odd, 35) == plain_words(ODD, 35)


def test_words_branches(table):
    """Paths that part and meet again, ends of documents, a passage twice in one document."""
    w = [f"w{k}" for k in range(400)]
    texts = [w[:120], w[:60] + w[200:260], w[30:120], w[300:360] + w[300:360], w[40:74], w[40:75], w[100:120] + w[:60]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    assert found_words(table(rows), 35) == plain_words(rows, 35)


def test_empty(empty):
    assert found_bytes(empty, 50) == [] and found_words(empty, 35) == []


def test_range_minima():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 200, 500).astype(np.uint8)
    lo = rng.integers(0, 500, 300)
    hi = np.minimum(499, lo + rng.integers(0, 200, 300))
    assert range_minima(values, lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo, hi)]


def test_column_rounds():
    """Windows of three symbols in aligned strings, against a dictionary."""
    rng = np.random.default_rng(3)
    grid = rng.integers(97, 99, (40, 8)).astype(np.uint8)
    grid[:10, :2] = ABSENT
    grid[30:, 6:] = ABSENT
    doc = rng.integers(0, 9, 40)
    who, where = repeated_windows(np.ascontiguousarray(grid.T), doc, 3, 6)
    wanted = set()
    for i in range(40):
        for c in range(6):
            window = grid[i, c : c + 3]
            if (window != ABSENT).all() and any((grid[j, c : c + 3] == window).all() and doc[j] < doc[i] for j in range(40)):
                wanted.add((i, c))
    assert set(zip(who.tolist(), where.tolist())) == wanted


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_fool_polynomials(table, n):
    one, two = folded_pair(n)
    around = [f"w{k}" for k in range(20)]
    rows = [(k, " ".join([*around, w, *around[::-1]])) for k, w in enumerate((one, two))]
    assert [r.n_removed for r in remove_repeated_words(table(rows)).collect()] == [0, 0]
    rows.append((2, rows[0][1]))
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeated_words(table(rows)).collect()) == [(0, 41), (1, 0), (2, 41)]
