"""Operators 11 to 13 against plain versions."""

import glob
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from eigenloom.llm import variant_trie
from eigenloom.llm.fill_middle import SkipLists, fill_in_middle, restored, units
from eigenloom.llm.packed_ids import PackedFile, bits_for, file_system, pack, read_token_ids, unpack, write_token_ids
from eigenloom.llm.pretokens import PieceEncoder
from eigenloom.llm.texts import utf8
from eigenloom.llm.variant_trie import spelling_variants
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import pyarrow as pa
from odd_rows import ODD

BYTES = str(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = str(public_tokenizers.path("word_bpe_49k.json"))
SF = "/root/testdata/sf0.001"


def plain_middle(doc_id, text):
    text = text or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(v % (len(w) + 1) for v in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(w), "plain", None, None, text
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < 20:
        return doc_id, len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def marked(rows):
    return rows + [(20 + k, f"some {m} text, 1 < 2 <P < S> <") for k, m in enumerate(["<P>", "<S>", "<M>", "", "", "", "", "<"])]


def test_middle(table):
    rows = marked(ODD)
    found = fill_in_middle(table(rows)).withColumn("back", restored(F.col("form"), F.col("output"))).collect()
    texts = Counter((i, t or "") for i, t in rows)
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted((plain_middle(*r) for r in rows), key=str)
    assert Counter((r.doc_id, r.back) for r in found) == texts


def test_middle_empty(empty):
    assert fill_in_middle(empty).count() == 0


def test_skip_lists_reach_every_rank():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab Zé1\U0001f600\n") for _ in range(n)) for n in (0, 1, 7, 8, 9, 400, 0, 5000)]
    width, first = units(*utf8(pa.array(texts)))
    lists = SkipLists(width, first)
    parts = [re.findall("[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert lists.n.tolist() == [len(p) for p in parts] and len(lists.lanes) > 3
    for _ in range(200):
        rank = np.array([rng.randint(0, len(p)) for p in parts])
        assert lists.points_before(rank).tolist() == [len("".join(p[:r])) for p, r in zip(parts, rank)]


@pytest.mark.parametrize("bits", [1, 2, 7, 8, 13, 16, 17, 24, 31, 32])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    raw = pack(ids, bits)
    assert len(raw) == (1001 * bits + 7) // 8
    assert unpack(np.frombuffer(raw, np.uint8), bits, 1001).tolist() == ids.tolist()


def test_bits_of_vocabulary():
    assert [bits_for(v) for v in (1, 2, 3, 256, 257, 50257, 65537)] == [1, 1, 2, 8, 9, 16, 17]


def test_pieces_are_those_of_the_library():
    rng, encoder = random.Random(1), PieceEncoder(BYTES)
    assert encoder.by_pieces and not PieceEncoder(WORDS).by_pieces
    signs = [*"ab'sS tTdé1²½ \n\t.,!  \x85\xa0\x1cı漢ñ😀́", " the", "\r\n", "'ll", " 's", "  ", "<|endoftext|>", "　"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    ids, begin = encoder.encode(texts, 2)
    for k, text in enumerate(texts):
        assert ids[begin[k] : begin[k + 1]].tolist() == encoder.whole(text) + [2], repr(text)


@pytest.mark.parametrize("tokenizer", [BYTES, WORDS])
def test_ids_written_and_read_back(table, tmp_path, tokenizer):
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    library = Tokenizer.from_file(tokenizer)
    path = f"file://{tmp_path}/ids"
    write_token_ids(table(rows), tokenizer, path, file_ids=1 << 14, block_ids=64)
    found = read_token_ids(table(rows).sparkSession, path).orderBy("start").collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows]
    assert [r.doc_id for r in found] == [i for i, _ in rows]
    assert Counter((r.doc_id, bytes(r.ids)) for r in found) == Counter((i, np.array(x, "<u4").tobytes()) for (i, _), x in zip(rows, ids))
    ends = np.cumsum([r.n_tokens for r in found])
    assert [r.start for r in found] == [0, *ends[:-1].tolist()] and ends[-1] == sum(map(len, ids))
    files = glob.glob(f"{tmp_path}/ids/*.ids")
    assert len(files) > 1
    at = {zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids}
    for name in files:
        file = PackedFile(*file_system(name))
        assert all(zlib.crc32(file.document(k).astype("<u4").tobytes()) in at for k in range(file.n_docs))
        every = file.ids(0, file.n_ids)
        lo, hi = file.n_ids // 3, file.n_ids - file.n_ids // 4
        assert file.ids(lo, hi).tolist() == every[lo:hi].tolist()


def test_no_ids(empty, tmp_path):
    write_token_ids(empty, BYTES, f"{tmp_path}/ids")
    assert read_token_ids(empty.sparkSession, f"{tmp_path}/ids").collect() == []


def plain_words(rows):
    low = {k: k + 32 for k in range(65, 91)}
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    holes = {}
    for w in n:
        for k in range(len(w)):
            for key in {(w[:k], w[k + 1 :], len(w))}:
                holes.setdefault(key, set()).add(w)
    partners = {w: set() for w in n}
    for same in holes.values():
        for a in same:
            partners[a] |= same - {a}
    for w in n:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            if short in n:
                partners[w].add(short)
                partners[short].add(w)
    out, form = [], {}
    for w in n:
        assert all(near(w, p) for p in partners[w])
        best = min(partners[w], key=lambda p: (-n[p], p), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(partners[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def found_variants(df):
    return sorted(tuple(r) for r in spelling_variants(df).collect())


def made_up():
    rng = random.Random(4)
    base = ["".join(rng.choice("abeéÿtÀ") for _ in range(rng.randint(6, 10))) for _ in range(60)]
    rows = []
    for k in range(400):
        words = []
        for _ in range(40):
            w = base[min(int(rng.expovariate(0.1)), 59)]
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", "éa", "B"]) + w[at + 1 :]
            words.append(w)
        rows.append((k, rng.choice([" ", "-", "1 "]).join(words)))
    return rows


def test_variants(table):
    rows = made_up() + ODD + ODD
    wanted = plain_variants(rows)
    assert len({r[5] for r in wanted}) < len(wanted)
    assert found_variants(table(rows)) == wanted


def test_variants_in_shards(table, monkeypatch):
    """Shards so small that the trie is divided down to its last level, and beyond it into chunks."""
    monkeypatch.setattr(variant_trie, "SHARD_WORDS", 1)
    monkeypatch.setattr(variant_trie, "BIN_WORDS", 50)
    rows = made_up()[:60] + [(900 + k, "àbcdefg ábcdefg gfedcbá gfedcbà bacdefgx bacdefg " * 2) for k in range(3)]
    assert found_variants(table(rows)) == plain_variants(rows)


def test_variants_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found_variants(spark.read.parquet(f"{SF}/documents.parquet")) == plain_variants(rows)


def test_no_variants(empty, table):
    assert found_variants(empty) == [] and found_variants(table([(1, None), (2, "once only"), (None, "")])) == []
