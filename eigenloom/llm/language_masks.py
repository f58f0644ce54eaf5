"""Language identification by n-gram filters that answer for all languages at once (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructType

from ..session import as_table, scratch_path
from .texts import FOLDED_CODES, SLICE_BYTES, prefix_sums, run_starts, slices, utf8, window_hashes

GRAM = 4
PROBES = 3
SAMPLE_PER_LANGUAGE = 5000
LEAST_SHARE = 0.002
MOST_LANGUAGES = 4096
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageMasks:
    """Bloom filters of all languages, bit-sliced: slot s of plane p holds one bit for each of 64 languages.

    The AND of an n-gram's slots has the bits of every language whose filter holds the n-gram, among
    them those that hold it by accident: for a language with a share f of its bits set, f^PROBES.
    """

    languages: tuple[str, ...]
    planes: np.ndarray
    accident: np.ndarray
    fallback: str

    @staticmethod
    def build(languages: list[str], grams: list[np.ndarray], fallback: str) -> LanguageMasks:
        slots = 1 << max(12, int(16 * max(map(len, grams), default=1)).bit_length())
        planes = np.zeros((-(-len(languages) // 64), slots), np.uint64)
        for k, found in enumerate(grams):
            bit = np.uint64(1) << np.uint64(k % 64)
            for probe in probes(found, slots):
                planes[k // 64, probe] |= bit
        bits = [((planes[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))]
        return LanguageMasks(tuple(languages), planes, np.array(bits) ** PROBES, fallback)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """n-grams of each row found in each language, less those expected by accident."""
        n_rows, n = len(offsets) - 1, len(self.languages)
        counts = np.zeros((n_rows, n))
        total = np.zeros(n_rows)
        for start, hashes, row in gram_blocks(data, offsets):
            total += np.bincount(row, minlength=n_rows)
            for p, plane in enumerate(self.planes):
                found = ~np.uint64(0)
                for probe in probes(hashes, len(plane)):
                    found = found & plane[probe]
                for k in range(64 * p, min(64 * p + 64, n)):
                    has = (found >> np.uint64(k % 64)) & np.uint64(1)
                    counts[:, k] += np.bincount(row, weights=has, minlength=n_rows)
        expected = total[:, None] * self.accident
        return np.maximum(0.0, (counts - expected) / np.maximum(1e-9, 1 - self.accident))

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        counts = self.counts(data, offsets)
        best, total = counts.argmax(axis=1), counts.sum(axis=1)
        top = counts[np.arange(len(best)), best]
        score = np.divide(top, total, out=np.zeros(len(best)), where=total > 0)
        return [self.languages[k] if t > 0 else self.fallback for k, t in zip(best, top)], score


def probes(hashes: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    bits = np.uint64(slots.bit_length() - 1)
    for k in range(PROBES):
        yield ((hashes >> np.uint64(k * (64 // PROBES))) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def gram_blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashes of all n-grams inside rows, with their rows, in stretches of bounded length."""
    for lo in range(0, max(0, len(data) - GRAM + 1), SLICE_BYTES):
        part = data[lo : lo + SLICE_BYTES + GRAM - 1]
        hashes = window_hashes(prefix_sums(FOLDED_CODES[part]), GRAM)
        at = lo + np.arange(len(hashes))
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + GRAM <= offsets[row + 1]
        yield lo, hashes[inside], row[inside]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language of a batch: in how many of its rows each n-gram occurs."""
    for b in batches:
        language = b.column(0).to_numpy(zero_copy_only=False)
        data, offsets = utf8(b.column(1))
        for lo, hi in slices(offsets, 4 * SLICE_BYTES):
            _, codes = np.unique(language[lo:hi], return_inverse=True)
            keys = [np.zeros(0, np.uint64)] * (codes.max() + 1)
            within = offsets[lo : hi + 1] - offsets[lo]
            for _, hashes, row in gram_blocks(data[offsets[lo] : offsets[hi]], within):
                order = np.lexsort((row, hashes))
                hashes, row = hashes[order], row[order]
                once = np.ones(len(row), bool)
                once[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
                hashes, code = hashes[once], codes[row[once]]
                for k in range(len(keys)):
                    keys[k] = np.concatenate((keys[k], hashes[code == k]))
            for k, found in enumerate(keys):
                found.sort()
                begin = run_starts(found)
                name = language[lo:hi][int(np.argmax(codes == k))]
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([name] * len(begin), pa.string()),
                        "gram": pa.array(found[begin].view(np.int64)),
                        "n": pa.array(np.diff(np.append(begin, len(found)))),
                    }
                )


def fit_languages(
    train: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    per_language: int = SAMPLE_PER_LANGUAGE,
    least_share: float = LEAST_SHARE,
) -> LanguageMasks:
    """Learn which n-grams of bytes a language uses.

    A language's sample is about ``per_language`` of its distinct texts, chosen by a hash of the text: that
    bounds the fit, however many copies there are. Of these, n-grams in at least ``least_share`` of the texts
    enter the filter; there can be no more than the mean number of n-grams in a text divided by
    ``least_share``, which bounds the model.
    """
    spark = train.sparkSession
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    found = rows.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("hash").alias("texts"))
    found = found.orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sizes = {r["lang"]: max(1, r["texts"]) for r in found}
    if not sizes:
        return LanguageMasks.build([], [], UNKNOWN)
    parts = 1 << 20
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(parts * min(1.0, per_language / n)))])
    sample = rows.where(F.pmod("hash", F.lit(parts)) < share[F.col("lang")]).dropDuplicates(["lang", "hash"])
    sample = as_table(sample.select("lang", "text"), scratch_path(spark, "sample"))
    held = {k: 0 for k in sizes} | {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    least = F.create_map(*[F.lit(x) for k, n in held.items() for x in (k, max(1, int(least_share * n)))])
    grams = sample.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram")
    grams = grams.agg(F.sum("n").alias("n")).where(F.col("n") >= least[F.col("lang")]).select("lang", "gram")
    table = grams.toArrow()
    names = table.column("lang").to_numpy()
    hashes = table.column("gram").to_numpy().view(np.uint64)
    languages = sorted(sizes)
    return LanguageMasks.build(languages, [hashes[names == k] for k in languages], found[0]["lang"])


def held_field(docs: DataFrame, keep: list[str], text_col: str) -> tuple[int, int] | None:
    """Where a text column lies in the kept ones: the column's and the field's number, if it is a string field of one."""
    outer, _, inner = text_col.partition(".")
    if outer not in keep or not isinstance(docs.schema[outer].dataType, StructType):
        return None
    found = [k for k, f in enumerate(docs.schema[outer].dataType.fields) if f.name.lower() == inner.lower()]
    if len(found) != 1 or docs.schema[outer].dataType.fields[found[0]].dataType != StringType():
        return None
    return keep.index(outer), found[0]


def identify_languages(
    docs: DataFrame, model: LanguageMasks, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns of every row, with lang_pred and score (0 to 1, the winner's share of the hits).

    Null, empty and letterless texts give ``und`` with score 0, as does any text if no language was
    learned. A text with letters and no known n-gram gives the commonest language with score 0. Ties go
    to the first language in name order. Repeated rows repeat. Whole texts are read, in stretches, so
    memory does not grow with them beyond their bytes. Other columns are ignored, kept ones named like
    the results give way to them. A text that is a field of a kept column (``_doc.text``) is sent once.
    """
    spark = docs.sparkSession
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    text = F.col(text_col).cast("string")
    place = held_field(docs, keep, text_col)
    sent = [] if place else [text.alias("_text")]
    rows = docs.select(*keep, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letters"), *sent)
    kept = [f for f in rows.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    arrow = pa.schema(
        [(f.name, to_arrow_type(f.dataType)) for f in kept] + [("lang_pred", pa.string()), ("score", pa.float64())]
    )
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts = b.column(len(keep) + 1) if place is None else pc.struct_field(b.column(place[0]), [place[1]])
            data, offsets = utf8(texts)
            letters = b.column(len(keep)).to_numpy(zero_copy_only=False)
            for lo, hi in slices(offsets, 4 * SLICE_BYTES):
                ok, part, within = letters[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                names, score = model.predict(part, within) if model.languages else ([], np.zeros(hi - lo))
                names = [n if o else UNKNOWN for n, o in zip(names or [UNKNOWN] * (hi - lo), ok)]
                columns = [b.column(k).slice(lo, hi - lo) for k in range(len(keep))]
                columns += [pa.array(names, pa.string()), pa.array(np.where(ok, score, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, f"{schema + ', ' if schema else ''}lang_pred string, score double")
