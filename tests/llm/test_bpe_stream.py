"""The encoder as a stream: any block size gives the library's ids, and memory does not grow with a word or a text."""

import random
import tracemalloc

import pytest

from tidewright.llm import bpe

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("block", [9, 40, 333])
def test_any_block_size_gives_the_same_ids(lib, block):
    own = bpe.WordBpe(PATH)
    own.block = block
    rng = random.Random(block)
    alphabets = ["aeiou", "abc'stdmrlve", "!?'<|>*", "éàạ́e", "世界한각", "a1 !é　\xa0\x85\x0b", "ΣσΑİ", "<|endoftext|>x "]
    for k in range(200):
        letters = rng.choice(alphabets) + rng.choice(alphabets) * (k % 3 == 0)
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(6 * block)))
        assert list(own.encode(text)) == lib.encode(text, add_special_tokens=False).ids, repr(text)
    for text in ("a" * 5 * block + "'s", "!" * 4 * block + "'s", "x'" * 3 * block + "re", "9" * 3 * block, "e" + "́" * 5 * block + "x"):
        assert list(own.encode(text)) == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit,times", [("ab'cd!", 160_000), ("abcdefgh", 40_000), ("the quick, brown fox ", 60_000), ("éß", 80_000), ("世界", 40_000)])
def test_memory_does_not_grow_with_a_text(unit, times):
    own = bpe.WordBpe(PATH)
    decoder = bpe.token_decoder(own.names)

    def peak(n):
        text, tokens = unit * n, 0
        tracemalloc.start()
        for piece in own.encode_stream(text):
            decoder.feed(bpe.array("I", piece))
            tokens += len(piece) // 4
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        decoder.finish()
        assert tokens
        return most

    small = peak(times // 8)
    assert peak(times // 4) < 1.5 * small + (2 << 20) and small < 40 << 20


def test_every_word_goes_through_the_transducer(monkeypatch):
    own, fed = bpe.WordBpe(PATH), []
    plain = bpe.Transducer.feed
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, ids: (fed.append(len(ids)), plain(self, ids))[1])
    own.encode("two words " + "x" * 100)
    assert fed == [3, 5, 100]
