import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eigenloom.llm.block_naming import whole_row
from eigenloom.llm.language_masks import UNKNOWN, LanguageMasks, fit_languages, identify_languages
from eigenloom.llm.nb_hinge import FEATURES, calibrate, dual_descent, fit_quality, indicators, score_quality
from eigenloom.llm.piece_viterbi import SPACE, Pieces, decode_pieces, encode_pieces
from eigenloom.llm.queries import op6_language_masks, op9_nb_hinge
from eigenloom.llm.texts import utf8
from odd_rows import ODD

SF = "/root/testdata/sf0.01"
MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def vocabulary():
    return Pieces(MODEL)


def best_by_hand(vocabulary, word):
    """Plain dynamic programme: the best worth and the pieces, longer last pieces first among equals."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=MODEL)
    score = {model.id_to_piece(int(i)): s for i, s in zip(vocabulary.ids, vocabulary.scores)}
    best, back = [0.0], [0]
    for end in range(1, len(word) + 1):
        top, start = -math.inf, 0
        for begin in range(max(0, end - vocabulary.longest), end):
            worth = score.get(word[begin:end], vocabulary.penalty if end - begin == 1 else -math.inf)
            if best[begin] + worth > top:
                top, start = best[begin] + worth, begin
        best.append(top)
        back.append(start)
    out, end = [], len(word)
    while end:
        out.append(word[back[end] : end])
        end = back[end]
    ids = []
    for piece in reversed(out):
        i = model.piece_to_id(piece)
        ids += [i] if piece in score else [int(vocabulary.byte_ids[x]) for x in piece.encode()]
    return ids


def test_segments_against_plain_programme(vocabulary):
    rng = random.Random(4)
    letters = "etaoinshrdlu" + "éß日ñ" + SPACE + "1,."
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    words += [SPACE + "international", SPACE * 5, "\n", "\U0001f600\n\t", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    for word, ids in zip(words, vocabulary.segment(words)):
        assert ids.tolist() == best_by_hand(vocabulary, word)


def test_segments_against_library(vocabulary):
    """The library finds the best segmentation too if told that the model is of that type."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(open(MODEL, "rb").read())
    spec.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    texts = ["The quick brown fox jumps over the lazy dog.", "Größe und Maß", "thhenter what hely  hentan", "El señor, 42 niños"]
    for text in texts:
        ids, offsets = vocabulary.encode([text])
        score = dict(zip(vocabulary.ids.tolist(), vocabulary.scores.tolist()))
        theirs = library.encode(text)
        assert sum(score[i] for i in ids.tolist()) == sum(score[i] for i in theirs)
        assert vocabulary.decode(ids, offsets) == [library.decode(theirs)] == [text]


def test_pieces_odd_rows(odd, empty):
    coded = encode_pieces(odd, MODEL)
    texts = sorted((str(r.doc_id), r.text) for r in decode_pieces(coded, MODEL).collect())
    assert texts == sorted((str(i), t or "") for i, t in ODD)
    assert encode_pieces(empty, MODEL).count() == 0 and decode_pieces(encode_pieces(empty, MODEL), MODEL).count() == 0


def test_decode_null_and_unknown(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [-5, 99_999_999])], "doc_id long, ids array<int>")
    texts = {r.doc_id: r.text for r in decode_pieces(rows, MODEL).collect()}
    assert texts[1] == texts[2] == "" and texts[3]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = op6_language_masks(spark, SF).join(docs, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_language_odd_rows(odd, table, empty):
    model = fit_languages(table([(1, "ababab ababab"), (2, "cdcdcd cdcdcd")]).withColumn("lang", F.when(F.col("doc_id") == 1, "x").otherwise("y")))
    rows = {}
    for r in identify_languages(odd, model).collect():
        rows.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert sum(map(len, rows.values())) == len(ODD)
    for k in (1, 2, 3):
        assert rows[k] == [(UNKNOWN, 0.0)]
    assert rows[7][0][0] in ("x", "y") and rows[7][0][1] == 0.0
    assert identify_languages(empty, model).count() == 0
    nothing = fit_languages(empty.withColumn("lang", F.lit("x")))
    assert {r.lang_pred for r in identify_languages(odd, nothing).collect()} == {UNKNOWN}


@pytest.mark.parametrize("seed", range(2))
def test_language_of_copies(spark, seed):
    """A language of copies of one text, in or out of any sample of rows, still learns from its other texts."""
    rng = random.Random(seed)
    word = lambda abc: "".join(rng.choice(abc) for _ in range(5))
    words = {"x": [word("abcdefgh") for _ in range(40)], "y": [word("mnopqrst") for _ in range(40)]}
    text = lambda k: "some words of both " + " ".join(rng.choice(words[k]) for _ in range(20))
    rows = [("x", text("x")) for _ in range(60)] + [("y", text("y")) for _ in range(60)]
    rows += [("x", "once again the same")] * 20_000
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    model = fit_languages(docs, per_language=100)
    fresh = spark.createDataFrame([(k, text(k)) for k in "xy" * 20], "lang string, text string")
    assert all(r.lang == r.lang_pred for r in identify_languages(fresh, model, keep=("lang",)).collect())


def test_masks_answer_for_all_languages():
    """Counts less the accidents are near the true ones, for more languages than one plane holds."""
    rng = np.random.default_rng(1)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 60)) for _ in range(70)]
    from eigenloom.llm.language_masks import gram_blocks

    grams = [np.unique(np.concatenate([h for _, h, _ in gram_blocks(*utf8(pa.array([t])))])) for t in texts]
    model = LanguageMasks.build([f"l{k:02}" for k in range(70)], grams, "l00")
    assert model.planes.shape[0] == 2
    names, score = model.predict(*utf8(pa.array(texts)))
    assert names == list(model.languages) and (score > 0.5).all()


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op9_nb_hinge(spark, SF).join(labels, "doc_id").where("held_out").select("score", "quality").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    assert (good[:, None] > bad).mean() > 0.95
    assert (good >= 0.3).mean() > 0.97


def test_quality_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (8, 0), (9, 1), (9, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = fit_quality(odd, labels)
    scores = [r.score for r in score_quality(odd, model).collect()]
    assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert score_quality(empty, model).count() == 0
    none = fit_quality(odd, labels.where("quality > 5"))
    assert {r.score for r in score_quality(odd, none).collect()} == {0.5}
    one = fit_quality(odd, labels.where("quality = 1"))
    assert all(r.score > 0.9 for r in score_quality(odd, one).collect())


def test_indicators_are_distinct():
    rows = list(indicators(*utf8(pa.array(["aaaa aaaa aaaa", "", None, "ab"]))))
    assert [len(x) == len(set(x.tolist())) for x in rows] == [True] * 4
    assert len(rows[1]) == len(rows[2]) == 0 and len(rows[3]) == 3


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 8) + 50 * (k % 2)).astype(np.int32) for k in range(60)]
    labels = np.arange(60) % 2
    ratio = np.ones(FEATURES)
    weights, bias = dual_descent(rows, labels, ratio)
    margin = np.array([weights[x].sum() / np.sqrt(len(x)) + bias for x in rows])
    assert ((margin > 0) == (labels == 1)).all()
    slope, offset = calibrate(margin, labels)
    assert slope > 0 and math.isfinite(offset)


def test_kept_columns_give_way(table):
    """Columns of the input that are named like a result are not kept beside it."""
    docs = table([(1, "ababab"), (2, "cdcdcd")]).withColumn("lang", F.lit("x"))
    found = identify_languages(docs, fit_languages(docs), keep=("doc_id", "score", "lang_pred", "tag"))
    assert found.columns == ["doc_id", "tag", "lang_pred", "score"] and found.where("lang_pred = 'x'").count() == 2
    coded = encode_pieces(docs, MODEL, keep=("doc_id", "ids", "text"))
    assert coded.columns == ["doc_id", "text", "ids"] and coded.where("size(ids) > 0").count() == 2
    texts = decode_pieces(coded, MODEL, keep=("doc_id", "text"))
    assert sorted(map(tuple, texts.collect())) == [(1, "ababab"), (2, "cdcdcd")]
    model = fit_quality(docs, docs.selectExpr("doc_id", "CAST(doc_id - 1 AS INT) AS quality"))
    scored = score_quality(docs, model, keep=("doc_id", "score"))
    assert scored.columns == ["doc_id", "score"] and scored.where("score BETWEEN 0 AND 1").count() == 2


def test_kept_text_is_sent_once(odd):
    model = fit_languages(odd.selectExpr("*", "'xx' AS lang"))
    whole = odd.select(whole_row(odd))
    once = identify_languages(whole, model, "_doc.text", keep=("_doc",))
    sent = once._jdf.queryExecution().analyzed().toString().splitlines()[1]
    assert "_letters" in sent and "AS _text" not in sent
    twice = identify_languages(odd.select(whole_row(odd), "text"), model, keep=("_doc",))
    rows = [sorted(map(str, df.select("_doc.doc_id", "_doc.text", "lang_pred", "score").collect())) for df in (once, twice)]
    assert rows[0] == rows[1]
