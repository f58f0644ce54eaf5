import random
from collections import Counter

import numpy as np
import pytest
from eigenloom.llm import bag_minhash
from eigenloom.llm.bag_minhash import (
    VALUES,
    apart_in_groups,
    bags,
    drop_near_duplicates,
    meeting,
    near_groups,
    nearest,
    signatures,
)
from eigenloom.llm.texts import utf8
import pyarrow as pa

from odd_rows import ODD


def bag(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def plain(rows):
    """Smallest id and size of the group of every row, by comparing all pairs."""
    found = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            least = sum((found[i] & found[j]).values())
            most = sum((found[i] | found[j]).values())
            if 5 * least >= 4 * most:
                parent[root(i)] = root(j)
    roots = [root(k) for k in range(len(rows))]
    size = Counter(roots)
    ids = {r: min((rows[k][0] for k in range(len(rows)) if roots[k] == r and rows[k][0] is not None), default=None) for r in size}
    return sorted(((rows[k][0], ids[roots[k]], size[roots[k]]) for k in range(len(rows))), key=str)


def found(df):
    return sorted((tuple(r) for r in near_groups(df).select("doc_id", "class_id", "group_size").collect()), key=str)


def test_odd_rows(odd):
    assert found(odd) == plain(ODD)


def test_families(table):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for family in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(8):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    assert found(table(rows)) == plain(rows)


def test_chain_of_links(table):
    """Each text is near the next one only; the ends have nothing in common."""
    words = [f"w{k}" for k in range(2000)]
    rows = [(k, " ".join(words[5 * k : 5 * k + 100])) for k in range(40)]
    assert found(table(rows)) == plain(rows) and plain(rows)[0][2] == 40


def test_counts_matter(table):
    rows = [(1, "a b c d e " * 50), (2, "a b c d e " * 45), (3, "a b c d e " * 30), (4, "a b c d e")]
    assert found(table(rows)) == plain(rows)


def test_signatures_are_unbiased():
    def sign(counts):
        texts = [" ".join(f"{item}" for item, n in c.items() for _ in range(n)) for c in counts]
        row, item, count = bags(*utf8(pa.array(texts)), shingle=1)
        return signatures(row, item, count, len(texts))

    rng = random.Random(2)
    pairs = []
    for _ in range(60):
        a = {f"x{rng.random()}": rng.choice([1, 1, 2, 7, 30]) for _ in range(40)}
        pairs += [a, {k: max(1, n + rng.choice([0, 0, 1, -1, 5])) for k, n in a.items()}]
    values = sign([Counter(p) for p in pairs])
    share, right = [], []
    for i in range(0, len(pairs), 2):
        a, b = Counter(pairs[i]), Counter(pairs[i + 1])
        share.append((values[i] == values[i + 1]).mean())
        right.append(sum((a & b).values()) / sum((a | b).values()))
    error = np.array(share) - np.array(right)
    assert abs(error.mean()) < 4 * 0.5 / np.sqrt(VALUES * len(error))
    assert np.isfinite(values).all()


def test_signature_does_not_depend_on_company():
    texts = ["a b c d e f g h", "z " * 700, "q w e r t y u i o p " * 20]
    alone = [signatures(*bags(*utf8(pa.array([t]))), 1)[0] for t in texts]
    together = signatures(*bags(*utf8(pa.array(texts))), 3)
    assert (np.array(alone) == together).all()


def test_drop_and_empty(odd, empty):
    assert found(empty) == []
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert kept.where("text = 'short text here'").count() == 1


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions(table, parts):
    rows = [(k, f"some words that make a text number {k % 5} and then a few more of them") for k in range(50)]
    assert found(table(rows, parts=parts)) == plain(rows)


def folded_pair(n):
    """Two different words whose every polynomial hash with an odd base agrees modulo 2^64."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_fool_polynomials(table, n):
    rows = [(k, w) for k, w in enumerate(folded_pair(n))]
    rows += [(10 + k, " ".join("xy"["ab".index(c)] for c in w)) for k, w in enumerate(folded_pair(n))]
    assert found(table(rows)) == plain(rows)
    assert {0, 1} <= {c for _, c, _ in plain(rows)}


def test_copies_with_edits_of_their_own(table):
    """Most are near the text they come from, some near another copy only, some near none."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    text = [rng.choice(words) for _ in range(150)]
    rows = [(0, " ".join(text))]
    for k in range(1, 300):
        copy = list(text)
        for _ in range(rng.choice([1, 2, 3, 3, 4, 4])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((k, " ".join(copy)))
        if k % 10 == 0:
            for _ in range(2):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 + k, " ".join(copy)))
    rng.shuffle(rows)
    assert found(table(rows)) == plain(rows)


def test_places_do_not_emit_their_pairs(spark):
    """One place of 400 classes of one group, 300 that none can be near, and one that only the likeliest may be."""
    group = [(k, 100 + k, 60 if k <= 12 else 40, True, True, 0) for k in range(400)]
    far = [(1000 + k, 500, 20, True, False, 1000 + k) for k in range(300)]
    rows = [(7, 8, False, *r) for r in [*group, *far, (2000, 50, 110, True, True, 2000)]]
    telling = spark.createDataFrame(rows, "a long, item long, more boolean, class long, slack long, cap long, x boolean, y boolean, label long")
    one, other = apart_in_groups(telling)
    assert one.count() + other.count() <= 30
    assert {tuple(r) for r in nearest(one, other).select("x", "y").collect()} >= {(2000, 0)}
    want = {
        (r[3], q[3]) for r in rows for q in rows
        if r[6] and q[7] and r[8] != q[8] and q[4] <= r[5] and r[4] <= q[5]
    }
    assert {tuple(r) for r in meeting(one, other).collect()} == want != set()


def test_strays_of_a_large_group(table, monkeypatch):
    """Strays share their differences with one another and with copies; what meets does not grow with their product."""
    rng = random.Random(17)
    words = [f"w{k}" for k in range(4000)]
    text = [rng.choice(words) for _ in range(150)]
    rows = []
    for k in range(400):
        copy = list(text)
        for at in rng.sample(range(0, 150, 10), rng.choice([1, 2, 3, 4, 5, 6])):
            copy[at] = rng.choice(words)
        rows.append((k, " ".join(copy)))
    kept = {}
    plain_table = bag_minhash.as_table

    def noted(df, path):
        kept.setdefault(path.rpartition("/")[2], []).append(out := plain_table(df, path))
        return out

    monkeypatch.setattr(bag_minhash, "as_table", noted)
    assert found(table(rows)) == plain(rows)
    one, other = kept["one"][-1], kept["other"][-1]
    assert meeting(one, other).count() <= 10 * len(rows)
