import hashlib
import random
from collections import defaultdict

from eigenloom.llm.block_naming import drop_exact_duplicates, exact_groups

from odd_rows import ODD


def plain(rows):
    groups, weight = defaultdict(set), defaultdict(int)
    for doc_id, text in rows:
        groups[text or ""].add(doc_id)
        weight[text or ""] += 1
    out = set()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out.add((i, keep, weight[text], i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return out


def found(df, **options):
    columns = "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    rows = [tuple(r) for r in exact_groups(df, **options).select(*columns).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_odd_rows(odd):
    assert found(odd) == plain(ODD)
    assert found(odd, block_bytes=3) == plain(ODD)


def test_deep_names(table):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.choice([5, 6, 7, 8, 9, 16])))) for k in range(300)]
    assert found(table(rows), block_bytes=2) == plain(rows)


def test_one_text_in_most_rows(table):
    rows = [(k, "the same text in very many documents" * 3 if k % 3 else f"text {k}") for k in range(3000)]
    assert found(table(rows), block_bytes=16) == plain(rows)


def test_empty(empty):
    assert found(empty) == set()
    assert drop_exact_duplicates(empty).count() == 0


def test_drop(odd):
    kept = drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    rows = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.select("doc_id", "text").collect())
    assert [r[1] for r in rows].count("short text here") == 1 and (6, "short text here") in rows
    assert len(rows) == len({t or "" for _, t in ODD})
