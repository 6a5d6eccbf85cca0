import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from chronostrata.llm import sentencepiece_codec as S


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=S.MODEL)


def ids(text):
    return np.frombuffer(S.codec().encode(text), np.int32).tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" ▁\n\taehinorst.,'é0129")), max_size=80))
def test_ids_are_the_librarys_and_come_back(text):
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    assert ids(text) == library.encode(text)
    assert S.codec().decode(ids(text)) == text.replace("▁", " ")


def test_runs_and_long_words(library):
    for n in (*range(1, 40), 97, 1000):
        for t in (" " * n, "a" + " " * n + "b", " " * n + "執", "x" + " " * n + "\n"):
            assert ids(t) == library.encode(t)
    rng = random.Random(0)
    t = "".join(rng.choice("abcdeinorst") for _ in range(50_000))
    assert ids(t) == library.encode(t)


def test_corpus(documents, library):
    for r in S.encode(documents).join(documents, "doc_id").collect():
        assert r["ids"] == library.encode(r["text"]) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]


def test_odd_rows(odd, none, library):
    got = S.encode(odd)
    assert got.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and got.count() == odd.count()
    by = {r["doc_id"]: r for r in got.where("doc_id IS NOT NULL").collect()}
    assert by[0]["ids"] is None and by[0]["n_tokens"] is None and by[1]["ids"] == [] and by[3]["round_trip"]
    assert S.encode(none).count() == 0
    back = {r["doc_id"]: r["text"] for r in S.decode(got.where("doc_id IS NOT NULL")).collect()}
    assert back == {r["doc_id"]: r["text"] and r["text"].replace("▁", " ") for r in odd.where("doc_id IS NOT NULL").collect()}


def test_ids_that_are_no_pieces(spark):
    rows = [(1, [35, 10**6]), (2, [None]), (3, None), (4, []), (5, [233])]
    got = {r["i"]: r["text"] for r in S.decode(spark.createDataFrame(rows, "i int, ids array<int>")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "", 5: "�"}
