"""BPE encoding and decoding as a streaming transducer with bounded lookahead.

``BpeModel`` reads a tokenizer file (JSON with vocab, merges and an end-of-word suffix) and
computes, from the merge list alone, how far to the right of a token other text can still change
it (the sufficient lookahead). All text goes through two machines in a row. ``BpeModel.parts`` takes
the text piece by piece and cuts it into parts of words, one state (no word, letters, other signs)
and at most three code points carried from piece to piece. ``Transducer`` takes a word's symbols,
keeps a buffer of one lookahead plus a block, emits the tokens that are stable and forgets them. So a
text or word of any length, with or without white space, takes constant memory besides the text and
the result itself (but for runs of combining marks, which normalisation sorts as a whole). Results of
words and of runs between white space are remembered while they are short. ``Decoder`` is an
incremental state machine from token ids to text: it holds back the bytes of an incomplete UTF-8
sequence until their continuation arrives.

Letter classes and lower case are those of the library's tables (see LATER and LOWER); composed
characters that Unicode 16 and later added are not composed here.

Nulls count as empty texts; empty texts give no ids. Extra columns of the input are kept but for those
that have the name of a result. Repeated rows are encoded each, an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm.common import Recent, free_name, give_back, read

TOKENIZER = "word_bpe_49k.json"

# White space of the tokenizer file's patterns (the Unicode property White_Space).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Code points that the regex module counts as letters or numbers and the library's older
# table does not know yet.
LATER = (
    "\\u0558\\u058b\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011de0-\\U00011de9\\U00011df1"
    "\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff"
    "\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6"
    "\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4\\U0001e6e5"
    "\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
# Lower case of letters that Unicode added after Python's table. A capital sigma is
# lowered without regard to its place in the word.
LOWER = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Code points from a word's start that decide whether it is one of the pattern's contractions.
LONGEST_CONTRACTION = 3


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class Transducer:
    """Of one word: symbols in, tokens out as soon as they are stable.

    A token that ends a sufficient lookahead before the buffer's end can't change any more, and the
    tokens after a token boundary don't depend on what stands before it. The newest symbol is held
    back, for it gets the suffix if the word ends."""

    def __init__(self, model: BpeModel):
        self.model, self.buffer = model, []
        self.size = model.lookahead + model.block + 1

    def push(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(symbols), self.model.block):
            self.buffer += symbols[i : i + self.model.block]
            if len(self.buffer) >= self.size:
                out += self.stable()
        return out

    def stable(self) -> list[int]:
        model, out, end, kept = self.model, [], 0, 0
        known = self.buffer[:-1]
        sure = len(known) - model.lookahead
        for t in model.merge(known):
            end += model.width[t]
            if end > sure:
                break
            out.append(t)
            kept = end
        del self.buffer[:kept]
        # a token longer than the block waits until the buffer reaches beyond it
        self.size = max(model.lookahead, len(self.buffer)) + model.block + 1
        return out

    def end(self) -> list[int]:
        if self.buffer:
            self.buffer[-1] = self.model.last_of[self.buffer[-1]]
        return self.model.merge(self.buffer)


class BpeModel:
    """block: symbols taken in beyond the lookahead before the buffer is tokenised."""

    def __init__(self, path: str, block: int = 256, cache_words: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[u], self.vocab[v]): r for r, (u, v) in enumerate(self.merges)}
        self.joined = [self.vocab[u + v] for u, v in self.merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.piece = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.alphabet = byte_alphabet()
        self.of_byte = [self.vocab[c] for c in self.alphabet]
        self.last_of = {self.vocab[c]: self.vocab[c + self.suffix] for c in self.alphabet}
        self.width = {i: len(t) - len(self.suffix) * bool(self.suffix and t.endswith(self.suffix)) for t, i in self.vocab.items()}
        self.lookahead = sufficient_lookahead(self.merges, self.suffix)
        self.block = block
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = pattern.replace("\\s", _SPACE)
        known = lambda x: x.replace("\\p{L}", f"[\\p{{L}}--[{LATER}]]").replace("\\p{N}", f"[\\p{{N}}--[{LATER}]]")
        self.words = regex.compile(known(pattern), regex.V1)
        self.ascii_words = re.compile(pattern.replace("\\p{L}", "a-z").replace("\\p{N}", "0-9"))  # of lower-cased ASCII
        self.letters = regex.compile(known("[\\p{L}]*"), regex.V1)
        self.others = regex.compile(known(f"[^{_SPACE}\\p{{L}}\\p{{N}}]*"), regex.V1)
        self.spaces = regex.compile(f"[{_SPACE}]+")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.opening = os.path.commonprefix(list(self.special))
        self.by_word = Recent(self.word, cache_words)
        self.by_run = Recent(self.run, cache_words)

    def forget(self) -> None:
        """Frees the caches: the worker goes on to other tasks, which may need the memory."""
        self.by_word.forget()
        self.by_run.forget()
        give_back()

    # -- encoding

    def segments(self, text: str, start: int, end: int) -> Iterator[tuple[int, int, int | None]]:
        """Parts of text[start:end] and, if a part is a special token's string, its id."""
        for m in self.cut.finditer(text, start, end) if self.cut else ():
            if m.start() > start:
                yield start, m.start(), None
            yield m.start(), m.end(), self.special[m[0]]
            start = m.end()
        if start < end:
            yield start, end, None

    def normalize(self, text: str) -> str:
        """NFC, one space for white space, lower case code point by code point."""
        return self.spaces.sub(" ", lowered(text))

    def pieces(self, text: str, start: int, end: int, lump: int) -> Iterator[str]:
        """text[start:end] normalised, in pieces of about a lump that normalise on their own."""
        while start < end:
            to = min(start + lump, end)
            while to < end and not starts_anew(text[to]):
                to += 1
            yield self.normalize(text[start:to])
            start = to

    def parts(self, pieces: Iterable[str]) -> Iterator[tuple[str, bool]]:
        """Cuts a stream of normalised text into words: parts of words, and whether the word ends
        with the part. Only a run of letters or of other signs can go on in the next piece."""
        run, carry, pieces = None, "", chain(pieces, [None])
        piece = next(pieces)
        while piece is not None:
            text, piece = carry + piece, next(pieces)
            last, at, carry = piece is None, 0, ""
            if run is not None:
                at = run.match(text).end()
                goes_on = at == len(text) and not last
                yield text[:at], not goes_on
                if goes_on:
                    continue
                run = None
            sure = len(text) - (0 if last else LONGEST_CONTRACTION)
            for m in (self.ascii_words if text.isascii() else self.words).finditer(text, at):
                if m.start() >= sure:
                    carry = text[m.start() :]
                    break
                if m.end() == len(text) and not last:
                    run = self.letters if self.letters.match(m[0]).end() else self.others
                yield m[0], run is None

    def merge(self, symbols: list[int]) -> list[int]:
        """Applies the merges in place, lowest rank first and leftmost first within a rank."""
        get, joined, none = self.rank.get, self.joined, len(self.joined)
        ranks = [get(pair, none) for pair in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            new = symbols[i] = joined[best]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = get((new, symbols[i + 1]), none)
        return symbols

    def symbols(self, part: str) -> list[int]:
        """Of each byte the id of its stand-in."""
        return list(map(self.of_byte.__getitem__, part.encode()))

    def word(self, word: str) -> tuple[str, tuple[int, ...]]:
        """Of a whole word: decimal ids joined by spaces, and the ids."""
        t, symbols = Transducer(self), self.symbols(word)
        if len(symbols) < t.size:  # nothing is stable before the end
            t.buffer = symbols
            ids = tuple(t.end())
        else:
            ids = tuple(t.push(symbols) + t.end())
        return " ".join(map(str, ids)), ids

    def stream(self, pieces: Iterable[str]) -> Iterator[Iterable[int]]:
        """Ids of a stream of normalised text."""
        open_word = None
        for part, ends in self.parts(pieces):
            if open_word is None and ends:
                yield self.by_word[part][1]
                continue
            open_word = open_word or Transducer(self)
            yield open_word.push(self.symbols(part))
            if ends:
                yield open_word.end()
                open_word = None

    def between(self, text: str, start: int, end: int, lump: int) -> Iterator[Iterable[int]]:
        """Ids of text[start:end], which no word or special token reaches beyond."""
        for a, b, special in self.segments(text, start, end):
            yield from [(special,)] if special is not None else self.stream(self.pieces(text, a, b, lump))

    def run(self, run: str) -> tuple[str, tuple[int, ...]]:
        """Of a run of text without white space: decimal ids joined by spaces, and the ids. A run
        without special tokens is one piece, which parts() would cut in one go."""
        if self.special and self.opening in run:
            ids = tuple(chain.from_iterable(self.between(run, 0, len(run), len(run))))
            return " ".join(map(str, ids)), ids
        if run.isascii():
            got = list(map(self.by_word.__getitem__, self.ascii_words.findall(run.lower())))
        else:
            got = list(map(self.by_word.__getitem__, self.words.findall(lowered(run))))
        if len(got) == 1:
            return got[0]
        return " ".join([g[0] for g in got]), tuple(chain.from_iterable([g[1] for g in got]))

    def encode(self, text: str, lump: int = 1 << 16) -> Iterator[list[tuple[str, tuple[int, ...]]]]:
        """Lists of what run() gives, for about a lump of the text each. Runs without white space
        that are longer than a lump are streamed."""
        at = 0
        while at < len(text):
            end = min(at + lump, len(text))
            m = self.spaces.search(text, end, end + lump)
            end = m.end() if m else end if end + lump < len(text) else len(text)
            part = text[at:end]
            if any(c in part for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, not to the file
                runs = [c for c in self.spaces.split(part) if c]
            else:
                runs = part.split()
            long = runs.pop() if not m and end < len(text) and runs and part.endswith(runs[-1]) else ""
            yield [g for g in map(self.by_run.__getitem__, runs) if g[1]]
            if long:
                m = self.spaces.search(text, end)
                start, end = end - len(long), m.start() if m else len(text)
                held: list[int] = []
                for ids in self.between(text, start, end, lump):
                    held += ids
                    if len(held) >= lump:
                        yield [(" ".join(map(str, held)), tuple(held))]
                        held = []
                if held:
                    yield [(" ".join(map(str, held)), tuple(held))]
            at = end

    def encode_ids(self, text: str) -> list[int]:
        return [i for got in self.encode(text) for _, ids in got for i in ids]


_LOWERED = frozenset(map(chr, LOWER))


def lowered(text: str) -> str:
    """NFC, and lower case code point by code point."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if not _LOWERED.isdisjoint(text):
            text = text.translate(LOWER)
    return text.lower()


@lru_cache(maxsize=1)
def _joins_the_previous() -> frozenset[str]:
    """The starters that normalisation can compose with what stands before: second parts of canonical
    pairs, vowels and finals of Hangul."""
    pairs = (unicodedata.decomposition(chr(c)) for c in range(0x110000))
    found = {chr(int(d.split()[1], 16)) for d in pairs if " " in d and "<" not in d}
    return frozenset(found) | frozenset(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))


def starts_anew(c: str) -> bool:
    """Whether normalisation of a text can be done apart from c on."""
    return c < "\x80" or unicodedata.combining(c) == 0 and c not in _joins_the_previous() and unicodedata.combining(unicodedata.normalize("NFD", c)[0]) == 0


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """How many symbols after a token's end can decide whether the token stands.

    A merge (u, v) fails where v has gone into an earlier merge (v, w), which in turn holds only
    if w was not taken by a merge earlier than that, and so on: a chain to the right of falling
    rank. Taking the merges in order of rank, ``own[t]`` is the longest such chain that takes t or
    a token on t's right edge before that token joined its parent.
    """
    def width(t: str) -> int:
        return len(t) - len(suffix) if suffix and t.endswith(suffix) else len(t)

    taken: dict[str, int] = {}  # by left operand, of merges so far
    edge: dict[str, int] = {}  # through the right edge of a merged token

    def reach(t: str) -> int:
        return max(taken.get(t, 0), edge.get(t, 0))

    for u, v in merges:
        far = reach(v)
        edge[u + v] = max(edge.get(u + v, 0), far)
        taken[u] = max(taken.get(u, 0), width(v) + far)
    return max([0, *taken.values(), *edge.values()])


class Decoder:
    """From ids to text, piece by piece. as_pieces: the file names no decoder, so that the library
    joins the pieces by single spaces; else bytes are put together and word ends become spaces."""

    def __init__(self, model: BpeModel, as_pieces: bool = True):
        self.model, self.as_pieces, self.first = model, as_pieces, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.byte = {} if as_pieces else {c: b for b, c in enumerate(model.alphabet)}

    def feed(self, token_id: int) -> str:
        piece = self.model.piece[token_id]
        if self.as_pieces:
            first, self.first = self.first, False
            return piece if first else " " + piece
        if piece in self.model.special:
            return self.utf8.decode(b"", True) + piece
        end = bool(self.model.suffix) and piece.endswith(self.model.suffix)
        raw = bytes(self.byte[c] for c in (piece[: -len(self.model.suffix)] if end else piece))
        return self.utf8.decode(raw) + (" " if end else "")

    def feed_all(self, token_ids: Iterable[int]) -> str:
        """What feed() gives for each, put together."""
        if not self.as_pieces:
            return "".join(map(self.feed, token_ids))
        pieces = list(map(self.model.piece.__getitem__, token_ids))
        if pieces and not self.first:
            pieces.insert(0, "")
        self.first = self.first and not pieces
        return " ".join(pieces)

    def close(self) -> str:
        return "" if self.as_pieces else self.utf8.decode(b"", True)


@lru_cache(maxsize=2)
def _model(path: str, cache_words: int = 200_000) -> BpeModel:
    return BpeModel(path, cache_words=cache_words)


def _encoded(model: BpeModel, text: str, kept: array | None, digests: bool) -> tuple:
    """The number of ids, which are added to kept, and the digests of them and of what they decode to,
    if those are wanted."""
    ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
    decoder = Decoder(model)
    for got in model.encode(text):
        if got:
            found = list(chain.from_iterable([g[1] for g in got]))
            if kept is not None:
                kept.extend(found)
            if digests:
                ids.update(((" " if n else "") + " ".join([g[0] for g in got])).encode())
                decoded.update(decoder.feed_all(found).encode())
            n += len(found)
    if digests:
        decoded.update(decoder.close().encode())
    return (n, ids.hexdigest(), decoded.hexdigest()) if digests else (n,)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, ids: bool = True, digests: bool = False, cache_words: int = 200_000) -> DataFrame:
    """Adds ``token_ids`` (array of int) if ids is set, and n_tokens, ids_sha256 and decoded_sha256 if
    digests is. Null texts give an empty array. Without ids the tokens are hashed while they
    stream out, and those of a text are never held as a whole. cache_words: results that a worker
    remembers, about 0.5 KB each."""
    path = path or tokenizer_path()
    kinds = [("token_ids", "array<int>")] * ids
    kinds += [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] * digests

    @F.arrow_udf(", ".join(f"{name} {sql}" for name, sql in kinds))
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(path, cache_words)
        try:
            for texts in batches:
                kept = array("i") if ids else None
                rows = [_encoded(model, t.as_py() or "", kept, digests) for t in texts]
                counts = [r[0] for r in rows]
                columns = []
                if ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(kept, np.int32) if len(kept) else [], pa.int32())))
                if digests:
                    columns += [pa.array(counts, pa.int64()), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2))]
                yield pa.StructArray.from_arrays(columns, [name for name, _ in kinds])
        finally:
            model.forget()

    names = [name for name, _ in kinds]
    made = free_name(docs, "_bpe")
    return docs.withColumn(made, encoded(F.col(text))).drop(*names).select("*", f"{made}.*").drop(made)


def decode(docs: DataFrame, ids: str = "token_ids", path: str | None = None, as_pieces: bool = True) -> DataFrame:
    """Adds ``decoded``. A null array gives the empty text."""
    path = path or tokenizer_path()

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        model = _model(path)

        def one(row) -> str:
            d = Decoder(model, as_pieces)
            return "".join([d.feed(int(i)) for i in (row if row is not None else ())]) + d.close()

        return pd.Series([one(r) for r in rows], dtype=object)

    return docs.withColumn("decoded", text(F.col(ids)))


def encode_digests(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256."""
    return encode(docs, text, path, ids=False, digests=True)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
