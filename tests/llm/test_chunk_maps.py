"""Chunk maps of the token counter: exact against the library, and joined in few rounds."""

import random

import public_tokenizers
import sentencepiece
from palimpsest.llm import tokencount
from palimpsest.llm.transducer import PieceTransducer

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_repetitive_texts(monkeypatch):
    rng, calls, plain = random.Random(3), [], tokencount._run

    def run(*args):
        calls.append(len(args[2]))
        return plain(*args)

    monkeypatch.setattr(tokencount, "_run", run)
    library, fsm = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceTransducer(MODEL)
    for text in ("a" * 50_000, "ab" * 20_000 + "==" * 9000, " " * 4000, "日本語é" * 3000, "".join(rng.choice("aaaaab ") for _ in range(20_000)), "the cat " * 3000):
        calls.clear()
        assert tokencount.count_pieces(fsm, [text]).tolist() == [len(library.encode(text))]
        chunks = -(-len(text) // tokencount.CHUNK) + 1
        assert len(calls) <= 8 and sum(calls) <= 4 * chunks, (text[:9], calls)


def test_single_path_when_maps_stay_open(monkeypatch):
    monkeypatch.setattr(tokencount, "CLOSING", 1)
    library, fsm = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceTransducer(MODEL)
    texts = ["a" * 3000, "", "b", "=" * 5000]
    assert tokencount.count_pieces(fsm, texts).tolist() == [len(library.encode(t)) for t in texts]


def test_tables_are_taken_over():
    texts = ["A house stood on the hill, 1234 years ago. " * 30, "été où\n"]
    one, two = PieceTransducer(MODEL), PieceTransducer(MODEL)
    want = tokencount.count_pieces(one, texts).tolist()
    two.restore(one.tables())
    states = len(two.states)
    assert tokencount.count_pieces(two, texts).tolist() == want and len(two.states) == states == len(one.states)
    assert tokencount.count_pieces(two, ["entirely other words: ząb, 世界"]).tolist() == tokencount.count_pieces(one, ["entirely other words: ząb, 世界"]).tolist()
