"""The transducer against the sentencepiece library, and unigram paths against all paths."""

import itertools
import random

import pytest
import sentencepiece
import small

from panelift.llm import tokenize


@pytest.fixture(scope="module")
def both():
    with open(tokenize.MODEL, "rb") as f:
        machine = tokenize.Transducer.read(f.read())
    return machine, sentencepiece.SentencePieceProcessor(model_file=tokenize.MODEL)


def test_same_ids_as_the_library(both):
    machine, library = both
    rng = random.Random(3)
    letters = "abcthe inorsé  \n\t🦙<>{}_=09AB▁ß日本"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [" " * n + "a" + " " * n for n in range(40)] + [t or "" for _, t, *_ in small.documents()]
    for text in texts:
        ids = machine.encode(text)
        assert ids == library.encode(text), text
        assert machine.decode(ids) == text.replace("▁", " ")
        assert machine.decode(ids) == library.decode(ids)


def test_long_parts(both):
    machine, library = both
    rng = random.Random(7)
    for text in (" " * 5000 + "the end", " " * 333, "a" * 3000, "".join(rng.choice("abcde ") for _ in range(5000)).replace(" ", "   ")):
        assert machine.encode(text) == library.encode(text)
    assert machine.decode(machine.encode(" " * 200_000 + "x")) == " " * 200_000 + "x"
    letters = "".join(rng.choice("abcdefgh") for _ in range(64))
    assert machine._merged_long(letters) == machine.merged(letters)


def test_broken_bytes_decode(both):
    machine, library = both
    assert machine.decode([machine.bytes[0xF0], machine.bytes[0x9F]]) == "�" == library.decode([machine.bytes[0xF0], machine.bytes[0x9F]])[:1]


def test_unigram_path_is_cheapest():
    pieces = [("<unk>", 0.0, tokenize.UNKNOWN)] + [(f"<0x{b:02X}>", 0.0, tokenize.BYTE) for b in range(256)]
    scores = {"a": -2.0, "b": -2.5, "c": -3.0, "ab": -3.2, "bc": -4.1, "abc": -6.9, "▁": -1.0, "▁a": -2.2, "ca": -3.9}
    machine = tokenize.Transducer(pieces + [(p, s, tokenize.NORMAL) for p, s in scores.items()], tokenize.UNIGRAM)
    rng = random.Random(1)
    for _ in range(200):
        part = "▁" + "".join(rng.choice("abcx") for _ in range(rng.randint(1, 7)))
        best = max(
            sum(scores.get(part[i:j], machine.floor if j - i == 1 else -1e9) for i, j in zip((0, *cut), (*cut, len(part))))
            for n in range(len(part)) for cut in itertools.combinations(range(1, len(part)), n)
        )
        path = machine.shortest_path(part)
        assert "".join(path) == part
        assert abs(sum(scores.get(p, machine.floor) for p in path) - best) < 1e-9


def test_query_round_trips(spark, awkward):
    from panelift.llm.queries import QUERIES

    rows = QUERIES["op6_sentencepiece"](spark, awkward).collect()
    assert all(r.n_tokens == len(r.ids) for r in rows)
    assert [r.doc_id for r in rows if not r.round_trip] == [24]  # holds the space sign itself
    assert {r.n_tokens for r in rows if r.doc_id in (10, 11)} == {0}


def test_existing_columns_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", "old")], "doc_id long, text string, ids string")
    assert tokenize.encode(docs).dtypes == [("doc_id", "bigint"), ("text", "string"), ("ids", "array<int>")]
