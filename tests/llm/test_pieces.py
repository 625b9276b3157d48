"""Ids against the SentencePiece library, and exact round trips."""

import pytest
import sentencepiece

from commentflow.llm import pieces, queries

TEXTS = [
    "", " ", "  ", "  a  ", "Hello  world\n\tÉç 𓀀 日本", "a\x00b", "x" * 300, " " * 40 + "y" + " " * 15,
    "aaaa aaa aa", "日" * 3 + "한국어 कखग", "The quick,brown.fox;  123456", "\n\n   indented   code(x, y)\r\n",
    "word " * 30000, "▁x ▁▁ y", "�  tail ",
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def compare(spark, model, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int, _x string").repartition(3)
    got = pieces.encode(df, queries.PIECES, decoded="decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert r.ids == model.encode(r.text), r.text[:40]
            assert r.decoded == model.decode(r.ids)
            if "▁" not in r.text:
                assert r.decoded == r.text


def test_against_library(spark, model):
    compare(spark, model, [(i, t, "x", 1, None) for i, t in enumerate([*TEXTS, None, *TEXTS[:3]])])


def test_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    compare(spark, model, [(d.doc_id, d.text, None, None, None) for d in docs])


def test_small_slices(model, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "SLICE", 10)
    coder = pieces.Encoder(pieces.vocabulary(queries.PIECES))
    assert coder.encode(pa.array([*TEXTS, None])).to_pylist() == [*map(model.encode, TEXTS), None]
    assert coder.encode(pa.array([], pa.string())).to_pylist() == []


def test_empty(spark):
    assert pieces.encode(spark.createDataFrame([], "text string"), queries.PIECES).count() == 0


def test_stored_ids(spark, model, tmp_path):
    """Ids written as a table and decoded later, beside columns of clashing names."""
    rows = [(i, t, "x", 1) for i, t in enumerate([*TEXTS, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text string, _ids int")
    pieces.encode(df, queries.PIECES).write.parquet(str(tmp_path / "ids"))
    stored = spark.read.parquet(str(tmp_path / "ids"))
    got = pieces.decode(stored.withColumnRenamed("text", "old"), queries.PIECES)
    assert got.columns == ["doc_id", "old", "_text", "_ids", "ids", "text"]
    for r in got.collect():
        assert r.text == (None if r.old is None else model.decode(r.ids)) and (r._text, r._ids) == ("x", 1)
    over = pieces.decode(stored.select("ids", "doc_id"), queries.PIECES, text="ids")
    assert over.dtypes == [("ids", "string"), ("doc_id", "bigint")] and over.count() == len(rows)


def test_broken_ids(spark, model):
    odd = [([300, 200],), ([],), (None,), ([model.piece_to_id("<0xE2>"), model.piece_to_id("<0x82>")],), ([model.piece_to_id("<0xFF>")] * 2,)]
    got = [r.text for r in pieces.decode(spark.createDataFrame(odd, "ids array<int>"), queries.PIECES).collect()]
    assert got[:3] == [model.decode([300, 200]), "", None] and set(got[3] + got[4]) == {"�"}
    for bad in ([-1], [10**6], [1, None]):
        with pytest.raises(Exception, match="id list holds"):
            pieces.decode(spark.createDataFrame([(bad,)], "ids array<int>"), queries.PIECES).collect()


class Other:
    """A model of another kind, as far as it is looked at."""

    def __init__(self, score=-1.0, back=None, byte=True):
        self.score, self.back, self.byte = score, back, byte

    def get_piece_size(self):
        return 1

    def is_byte(self, i):
        return self.byte and i == 5

    def is_control(self, i):
        return False

    is_unknown = is_control

    def get_score(self, i):
        return self.score

    def piece_to_id(self, piece):
        return 5

    def encode(self, text):
        return text

    def decode(self, ids):
        return self.back or ids


def test_other_models_are_refused():
    pieces._check(Other())
    for model in (Other(score=-3.25), Other(back="fi 1 A x"), Other(byte=False)):
        with pytest.raises(ValueError):
            pieces._check(model)
