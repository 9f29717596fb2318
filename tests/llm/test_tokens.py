import random

import pyarrow as pa  # noqa: F401
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from clicklens.llm.edit_counts import PATTERN, CountTree, edited_counts, middle_edit, rank_encoding
from clicklens.llm.sentencepieces import Codec, decode_pieces, encode_pieces, model_pieces

MODEL, RANKS = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken"
ODD = ["", "a", " a  b ", "日本語 🎉🎉 x", "\n\n\t x", "<0x41> <s> </s>", " " * 9, "don't we'll", "x" * 3000]


@pytest.fixture(scope="module")
def unigram():
    """The library's own Viterbi over the same pieces; scores of rare spaces are cut to its number range."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    for p in model.pieces:
        p.score = max(p.score, -40000.0)
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


@pytest.fixture(scope="module")
def coder():
    rows, prefix = model_pieces(MODEL)
    return Codec([(a, max(b, -40000.0), c) for a, b, c in rows], prefix)


def texts(spark, n):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(n).collect()]


def test_best_score_is_the_library_s(spark, coder, unigram):
    score = lambda ids: sum(coder.rows[i][1] for i in ids)
    for text in texts(spark, 150) + ODD:
        mine = coder.encode(text)
        assert score(mine) == score(unigram.encode(text))
        assert coder.decode(mine) == text == unigram.decode(mine)


def brute_score(rows, floor, text):
    best = [0.0] + [float("-inf")] * len(text)
    single = {p for p, _, _ in rows if len(p) == 1}
    for end in range(1, len(text) + 1):
        for piece, score, _ in rows:
            if text[:end].endswith(piece):
                best[end] = max(best[end], best[end - len(piece)] + score)
        if text[end - 1] not in single:
            best[end] = max(best[end], best[end - 1] + floor)
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("abc▁", max_size=12), st.dictionaries(st.text("ab▁", min_size=1, max_size=3), st.integers(-20, -1), max_size=8))
def test_viterbi_equals_all_segmentations(text, scores):
    rows = [(p, float(s), 1) for p, s in scores.items()]
    own = Codec([("<unk>", 0.0, 2), *rows], False)
    steps = own.segment(text)
    total = sum(own.floor if piece < 0 else own.rows[piece][1] for piece, _ in steps)
    assert sum(n for _, n in steps) == len(text)
    assert total == brute_score(rows, own.floor, text)


def test_encode_and_decode_tables(spark, odd_documents, no_documents):
    rows = encode_pieces(odd_documents, MODEL)
    found = decode_pieces(rows.withColumnRenamed("text", "before"), MODEL).collect()
    assert len(found) == 8 and rows.columns[:7] == odd_documents.columns
    assert all(r.text == (r.before or "") and r.n_pieces == len(r.piece_ids) and r.round_trip for r in found)
    assert encode_pieces(no_documents, MODEL).count() == 0
    again = encode_pieces(rows, MODEL)  # clashing names are replaced
    assert again.columns == rows.columns and again.count() == 8


def test_mark_in_a_text_is_reported(spark):
    rows = encode_pieces(spark.createDataFrame([("a▁b",)], "text string"), MODEL).collect()
    assert not rows[0].round_trip


@pytest.fixture(scope="module")
def count():
    with open(RANKS, "rb") as f:
        encoding = rank_encoding(f.read(), PATTERN)
    return lambda parts: [len(encoding.encode_ordinary(p)) for p in parts]


def test_trees_follow_edits(spark, count):
    rng = random.Random(4)
    news = ["", "x", " y z", " ", "\n", "’s don't", "日本", " " * 7, "word " * 200]
    for text in texts(spark, 60) + ODD:
        tree, now = CountTree(text, count), text
        assert tree.tokens == count([now])[0]
        for _ in range(6):
            start = rng.randint(0, len(now) + 2)
            end = start + rng.randint(0, 400)
            new = rng.choice(news)
            now = now[: min(start, len(now))] + new + now[min(end, len(now)) :]
            tree.edit(start, end, new)
            assert (tree.tokens, tree.chars) == (count([now])[0], len(now))
            assert "".join(tree.parts) == now


def test_edits_encode_little(spark, count):
    text = " ".join(texts(spark, 40))
    tree = CountTree(text, count)
    tree.edit(len(text) // 2, len(text) // 2 + 5, "other")
    assert tree.encoded < 4000 < len(text)
    assert tree.updated < 60


def test_edited_counts(spark, odd_documents, no_documents, count):
    for r in edited_counts(odd_documents, middle_edit, RANKS, PATTERN).collect():
        text = {x.doc_id: x.text for x in odd_documents.collect()}[r.doc_id] or ""
        now = text
        for start, end, new in middle_edit(text):
            now = now[:start] + new + now[end:]
        assert (r.n_chars, r.n_tokens) == (len(text), count([text])[0])
        assert (r.edited_chars, r.edited_tokens) == (len(now), count([now])[0])
    assert edited_counts(no_documents, middle_edit, RANKS, PATTERN).count() == 0
