"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

The lookahead comes from the merge list. Whether a merge (u, v) happens at a place can depend on text to its
right only if some symbol that v ends in is taken by a merge of lower rank with what follows; that merge may
in turn be undone by one of still lower rank further right, and so on. Ranks fall along such a chain, so the
longest one is found by dynamic programming over the merges in rank order (``sufficient_lookahead``).

A boundary between tokens that lies at least this many symbols before the end of what has been read is
therefore final, and by the same argument the text on its two sides can be tokenised apart. The transducer holds
a window of a pre-token, tokenises it, emits the tokens before the last stable boundary and reads on. Every
pre-token goes through it; a memo of bounded size keeps what it returned for short ones.

Texts are read in blocks of ``BLOCK`` characters, cut at white space. A stretch without white space that is longer
than a block is normalised up to characters that no normalisation joins to what is before them, and a pre-token
that does not end in its block stays open: its bytes go to the transducer as they come. So beyond the text itself
memory does not grow with the length of a text, a word or a pre-token (a run of combining marks, which
normalisation sorts, is held whole).

Reference for the idea: Berglund and van der Merwe, "Formalizing BPE Tokenization" (2023).
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from .common import bound_batches, rows_of


def byte_alphabet() -> list[str]:
    """The printable stand-in for each byte: visible Latin-1 is itself, the rest follow from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256))
    return [chr(b) if b in visible else chr(256 + next(spare)) for b in range(256)]


class Merges:
    """A merge list over the ids of symbols, with ``end`` marking the last symbol of a pre-token."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int], end: str = ""):
        self.vocab, self.end = vocab, end
        known = [(k, a, b) for k, (a, b) in enumerate(merges) if a in vocab and b in vocab and a + b in vocab]
        self.rank = {(vocab[a], vocab[b]): k for k, a, b in known}
        self.made = {k: vocab[a + b] for k, a, b in known}
        self.width = {i: len(t) - (len(end) if end and t.endswith(end) else 0) for t, i in vocab.items()}
        self.lookahead = sufficient_lookahead(merges, end)

    def tokens(self, ids: list[int]) -> list[int]:
        """Merge in place by lowest rank, leftmost first."""
        never = 1 << 60
        get, made = self.rank.get, self.made
        ranks = [get(pair, never) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), never)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), never)
        return ids

    def stream(self, ids: Iterable[int], window: int | None = None) -> Iterator[int]:
        """Tokens of one pre-token, each as soon as it is stable. Symbols ``ids`` are read once, left to right."""
        machine = Transducer(self, window)
        for s in ids:
            yield from machine.feed([s])
        yield from machine.finish()


class Transducer:
    """Symbols of one pre-token in, its tokens out. State: the symbols behind the last stable boundary, a window at most."""

    def __init__(self, merges: Merges, window: int | None = None):
        self.merges, self.held = merges, []
        self.window = max(window or 0, 4 * merges.lookahead + 64)

    def feed(self, ids: list[int]) -> list[int]:
        """Reads more symbols; the tokens that have become stable."""
        held, width, out, at = self.held, self.merges.width, [], 0
        while at < len(ids):
            more = ids[at : at + self.window - len(held)]
            held += more
            at += len(more)
            if len(held) >= self.window:
                stable, done = len(held) - self.merges.lookahead, 0
                for token in self.merges.tokens(held.copy()):
                    if done + (w := width[token]) > stable:
                        break
                    out.append(token)
                    done += w
                if not done:
                    raise ValueError("a token is longer than the window")
                del held[:done]
        return out

    def finish(self) -> list[int]:
        """The rest, as no more symbols come; ready for the next pre-token."""
        out, self.held = self.merges.tokens(self.held), []
        return out


def sufficient_lookahead(merges: list[tuple[str, str]], end: str = "") -> int:
    """Symbols beyond a place that settle whether a token boundary is there, whatever follows."""
    made = {a + b: (k, b) for k, (a, b) in reversed(list(enumerate(merges)))}
    width = lambda s: len(s) - (len(end) if end and s.endswith(end) else 0)
    # By left symbol: ranks so far, and the longest reach among the merges up to each of them.
    ranks: dict[str, list[int]] = {}
    reach: dict[str, list[int]] = {}
    longest = 1
    for k, (a, b) in enumerate(merges):
        need, symbol, before = 0, b, k
        while True:  # b itself, then the symbols that its right edge was made of
            known = ranks.get(symbol)
            if known and (n := bisect_left(known, before)):
                need = max(need, reach[symbol][n - 1])
            if symbol not in made or made[symbol][0] >= before:
                break
            before, symbol = made[symbol]
        need += width(b)
        ranks.setdefault(a, []).append(k)
        reach.setdefault(a, []).append(max(need, reach[a][-1] if reach.get(a) else 0))
        longest = max(longest, need + width(a))
    return longest


#: Entries of a memo's generation, of pieces and of words; longer strings are not kept.
PIECES, WORDS, LONG = 1 << 19, 1 << 18, 64
#: Characters of a text that are normalised and split at once.
BLOCK = 1 << 16
#: Characters by which what follows can change how a text is split: the longest fixed alternative of the pattern.
EDGE = 4
WHITE = regex.compile(r"[ \t\n\r]")


class Cache(dict):
    """Packed ids of short strings; what is missing is worked out by ``find``.

    Two generations: when this one is full it becomes the old one, from which entries come back on demand.
    """

    def __init__(self, find: Callable[[str], bytes], size: int):
        super().__init__()
        self.find, self.size, self.old = find, size, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.pop(key, None)
        if found is None:
            found = self.find(key)
        if len(key) <= LONG:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class WordBpe:
    """A tokenizer file of the word-end BPE kind: encode and decode whole texts as streams."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            raise ValueError("not a tokenizer of the word-end BPE kind")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(pairs, self.vocab, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        # Beyond Latin-1, character classes depend on a Unicode version, so the library's own are used.
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.other_split = pre_tokenizers.Split(Regex(steps[0]["pattern"]["Regex"]), "removed", invert=True)
        self.cuts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # White space is in no pre-token, so what lies between is split and cached by itself.
        if self.split.search(" \t\n\r\x0b\x0c\x85\xa0"):
            raise ValueError("pre-tokens may hold white space")
        alphabet = byte_alphabet()
        self.inner = [self.vocab.get(c) for c in alphabet]
        self.final = [self.vocab.get(c + self.merges.end) for c in alphabet]
        self.by_word, self.by_piece = Cache(self.word, WORDS), Cache(self.piece, PIECES)
        self.block = BLOCK

    def word(self, word: str) -> bytes:
        """Packed ids (little-endian, 32 bits) of one pre-token: its bytes, the last with the end mark, merged.

        Bytes that the vocabulary lacks are left out.
        """
        machine, out, raw = Transducer(self.merges), array("I"), word.encode("utf-8")
        for start in range(0, len(raw), self.block):
            part = [self.inner[b] for b in raw[start : start + self.block]]
            if start + self.block >= len(raw):
                part[-1] = self.final[raw[-1]]
            out.extend(machine.feed([i for i in part if i is not None]))
        out.extend(machine.finish())
        return out.tobytes()

    def piece(self, piece: str) -> bytes:
        """Packed ids of a lower-case Latin-1 text without white space."""
        return b"".join(map(self.by_word.__getitem__, self.split.findall(piece)))

    def _block(self, text: str) -> bytes:
        """Packed ids of a text with white space, or an end of the whole text, on both sides."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return b"".join(self.by_word[w] for w, _ in self.other_split.pre_tokenize_str(self.normalizer.normalize_str(text)))
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
            return b"".join(map(self.by_word.__getitem__, self.split.findall(text.lower())))
        return b"".join(map(self.by_piece.__getitem__, text.lower().split()))  # Latin-1 text is composed already

    def _plain(self, text: str, at: int, stop: int) -> Iterator[bytes]:
        """Packed ids of ``text[at:stop]``, which has no special token, block by block."""
        while at < stop:
            end = min(at + self.block, stop)
            if end < stop:
                cut = max(text.rfind(c, at, end) for c in " \t\n\r")
                if cut < at:
                    white = WHITE.search(text, end, stop)
                    end = white.start() if white else stop
                    yield from self._stretch(text, at, end)
                    at = end
                    continue
                end = cut + 1
            yield self._block(text[at:end])
            at = end

    def _stretch(self, text: str, at: int, stop: int) -> Iterator[bytes]:
        """Packed ids of a stretch that is longer than a block and has no white space to cut at."""
        rest, run = "", OpenRun(self)
        while at < stop:
            end = min(at + self.block, stop)
            while end < stop and not stands_alone(text[end]):
                end += 1
            rest += self.normalizer.normalize_str(text[at:end])
            at = end
            if run.probe:  # a pre-token from before: what the probe's class takes in goes on
                n = self.other_split.pre_tokenize_str(run.probe + rest)[0][1][1] - 1
                yield run.feed(rest[:n])
                rest = rest[n:]
                if not rest and at < stop:
                    continue
                yield run.finish()
            found, done = self.other_split.pre_tokenize_str(rest), 0
            for word, (first, after) in found:
                if at < stop and after > len(rest) - EDGE:
                    if after == len(rest) and after - first >= 2 * EDGE:  # no fixed alternative is so long: a run
                        yield run.open(word)
                        done = after
                    break
                yield self.by_word[word]
                done = after
            rest = rest[done:]
        if run.probe:
            yield run.finish()

    def encode_stream(self, text: str) -> Iterator[bytes]:
        """Packed ids of the text, block by block. Special tokens in the raw text are found before all else."""
        at = 0
        for m in self.cuts.finditer(text) if self.cuts else ():
            yield from self._plain(text, at, m.start())
            yield array("I", [self.special[m[0]]]).tobytes()
            at = m.end()
        yield from self._plain(text, at, len(text))

    def encode(self, text: str) -> array:
        ids = array("I")
        for piece in self.encode_stream(text):
            ids.frombytes(piece)
        return ids


def stands_alone(c: str) -> bool:
    """No normalisation form C joins this character to one before it, so a text may be cut in front of it."""
    if c < "\u0300":
        return True
    # Vowel and trailing consonant letters that compose with what is before them, though they are no marks.
    composing = "\u1160" <= c <= "\u11ff" or "\U00016d40" <= c <= "\U00016d7f"
    return not composing and unicodedata.combining(c) == 0 and unicodedata.category(c)[0] not in "MC"


class OpenRun:
    """A pre-token whose end has not been seen. ``probe`` is a character of its class, or empty: none is open.

    The last byte is held back, since it takes the end mark if nothing follows.
    """

    def __init__(self, bpe: WordBpe):
        self.bpe, self.machine, self.probe, self.last = bpe, Transducer(bpe.merges), "", None

    def open(self, word: str) -> bytes:
        self.probe = "a" if len(self.bpe.other_split.pre_tokenize_str("a" + word[0])) == 1 else "!"
        return self.feed(word)

    def feed(self, more: str) -> bytes:
        raw = more.encode("utf-8")
        if not raw:
            return b""
        before, inner = ([] if self.last is None else [self.last]), self.bpe.inner
        self.last = raw[-1]
        return array("I", self.machine.feed([i for b in (*before, *raw[:-1]) if (i := inner[b]) is not None])).tobytes()

    def finish(self) -> bytes:
        end = self.bpe.final[self.last]
        out = array("I", self.machine.feed([] if end is None else [end]))
        out.extend(self.machine.finish())
        self.probe, self.last = "", None
        return out.tobytes()


class Decoder:
    """Tokens in, text out: an incremental byte-to-text state machine.

    Tokens' bytes follow each other, with ``separator`` between them. State: the bytes of a character that is not
    complete yet, and whether a token has come.
    """

    def __init__(self, pieces: dict[int, bytes], separator: bytes = b""):
        self.pieces, self.skip, self.begun = {i: separator + b for i, b in pieces.items()}, len(separator), False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.pieces.__getitem__, ids))
        if raw and not self.begun:
            self.begun, raw = True, raw[self.skip :]
        return self.state.decode(raw)

    def finish(self) -> str:
        """What is left over; ready for the next text."""
        text, self.begun = self.state.decode(b"", final=True), False
        self.state.reset()
        return text


def token_decoder(names: dict[int, str]) -> Decoder:
    """For files without a decoder step, such as this one: tokens' own strings with single spaces between."""
    return Decoder({i: t.encode("utf-8") for i, t in names.items()}, b" ")


def byte_decoder(names: dict[int, str], special: Iterable[str] = ()) -> Decoder:
    """For files of the byte-level kind with a byte decoder: the bytes that tokens' characters stand for."""
    back, special = {c: b for b, c in enumerate(byte_alphabet())}, set(special)
    return Decoder({i: t.encode("utf-8") if t in special else bytes(back[c] for c in t) for i, t in names.items()})


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row: encoded and decoded again, as streams.

    ``with_ids`` adds ``ids array<int>``. Null text counts as empty (no token; decoded to the empty text). Ids
    of documents pass through, null or repeated. Extra columns are ignored; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        bpe = load(path)
        decoder = token_decoder(bpe.names)
        for batch in batches:
            n, ids_sha, text_sha, packed = [], [], [], []
            for part in rows_of(batch, 1):
                for text in part:
                    total, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                    for piece in bpe.encode_stream(text):
                        of_ids.update(piece)
                        ids = array("I", piece)
                        total += len(ids)
                        of_text.update(decoder.feed(ids).encode("utf-8"))
                        if with_ids:
                            packed.append(piece)
                    of_text.update(decoder.finish().encode("utf-8"))
                    n.append(total), ids_sha.append(of_ids.hexdigest()), text_sha.append(of_text.hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(run, schema)
