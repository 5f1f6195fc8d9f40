"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

Encoding. A word is a string of symbols: its bytes, the last one marked as a word's end. The encoding of any prefix
ends with exactly one token t, and what stands before t is the encoding of the prefix without t; t is the longest token there
whose pair with the last token before it is left alone by the merge list. So the encodings of all prefixes form a tree. A token covers at most
`lookahead` symbols (the longest entry of the merge list), so every later prefix descends from one of the last `lookahead` positions. A token is stable, and is emitted,
once it lies on the path of all of these; nothing before it is kept. Memory follows the lookahead, not the word.
Which tokens end at a position is told by an automaton, whose state is the longest end of what has been read that begins a token; its moves are kept.

Decoding. Tokens become bytes one at a time, and bytes become text by a UTF-8 state machine that holds back
an unfinished character only.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from siftstone.llm.common import ship, texts
from siftstone.llm.packing import byte_letters

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: White space of the normaliser and of the pattern (the Unicode property).
SPACE = r"[\t-\r \x85\xa0  -     　]+"
#: Encoded words that a worker keeps.
CACHE_ENTRIES = 400_000
#: Moves of the transducer's automaton that a worker keeps.
STATES = 400_000
#: Pairs of tokens of which a worker keeps whether they stand, about.
PAIRS = 1 << 18
#: Last characters of patterns; the fewer characters a pattern knows, the faster it is.
LASTS = (0x7F, 0xFFFF, sys.maxunicode)


@lru_cache(8)
def ranges(category: str, last: int = sys.maxunicode) -> str:
    """All characters of a category, up to the last, as the inside of a character class, in the Unicode version of the tokenizers library."""
    every = "".join(map(chr, (c for c in range(last + 1) if not 0xD800 <= c < 0xE000)))
    runs = pre_tokenizers.Split(Regex(rf"\p{{{category}}}+"), "removed", invert=True).pre_tokenize_str(every)
    out = []
    for run, _ in runs:
        at = 0
        while at < len(run):  # a run may pass over the surrogates
            end = at
            while end + 1 < len(run) and ord(run[end + 1]) == ord(run[end]) + 1:
                end += 1
            out.append(f"\\U{ord(run[at]):08x}-\\U{ord(run[end]):08x}")
            at = end + 1
    return "".join(out)


class Kept(dict):
    """What a worker keeps, in two generations: when the young one is full it becomes the old one, and what is asked for again becomes young."""

    def __init__(self, most: int):
        self.most, self.old = most // 2, {}

    def __missing__(self, key):
        """The old value made young, or None."""
        known = self.old.get(key)
        if known is not None:
            self.put(key, known)
        return known

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            super().clear()
        self[key] = value

    def clear(self) -> None:
        super().clear()
        self.old = {}


class Beside(dict):
    """By right token, whether it stands beside this left one: "" is a word's start, beside which all do; None is nothing."""

    __slots__ = ("left", "merges")

    def __init__(self, left: str | None, merges: Merges):
        self.left, self.merges = left, merges

    def __missing__(self, right: str) -> bool:
        self.merges.pairs += 1
        self[right] = found = self.left == "" if not self.left else self.merges.stand(self.left, right)
        return found


class Pairs(dict):
    """By left token, what stands beside it."""

    __slots__ = ("merges",)

    def __init__(self, merges: Merges):
        self.merges = merges

    def __missing__(self, left: str | None) -> Beside:
        if self.merges.pairs > PAIRS:
            self.merges.pairs = 0
            self.clear()
        self[left] = found = Beside(left, self.merges)
        return found


class Merges:
    """A merge list over symbols; gives the last tokens of prefixes and tells which pairs of tokens stand."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.rank = {pair: i for i, pair in enumerate(map(tuple, merges))}
        self.parts = {a + b: (a, b) for a, b in reversed(self.rank)}
        self.width = {t: self._symbols(t) for t in vocab}
        #: No token covers more symbols than this; it suffices as lookahead.
        self.lookahead = max(self.width[t] for t in self.parts)
        #: Tokens that are their own encoding, and what they begin with, in whole symbols.
        self.own = {t for t in vocab if self.merged(self.split(t)) == [t]}
        self.begins = self.own | {t[:i] for t in self.own for i in range(1, self.width[t])}
        self.stands, self.pairs = Pairs(self), 0
        #: The automaton: by state and symbol, the next state and the tokens (width, token) that end there, the longest first.
        self.moves: dict[str, tuple[str, tuple]] = {}
        self.ends = lru_cache(None)(self._ends)  # as many as `begins` at most

    def _symbols(self, token: str) -> int:
        return len(token) - len(self.end) if self.end and token.endswith(self.end) and len(token) > len(self.end) else len(token)

    def symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.end]

    def merged(self, symbols: list[str]) -> list[str]:
        """The whole encoding of a short word: always join the pair that comes first in the list, leftmost first."""
        out, rank, never = list(symbols), self.rank, 1 << 60
        ranks = [rank.get(pair, never) for pair in zip(out, out[1:], strict=False)]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((out[i - 1], out[i]), never)
            if i < len(ranks):
                ranks[i] = rank.get((out[i], out[i + 1]), never)
        return out

    def split(self, token: str) -> list[str]:
        """The symbols of a token."""
        n = self.width[token]
        return [*token[: n - 1], token[n - 1 :]]

    def stand(self, left: str, right: str) -> bool:
        return self.merged([*self.split(left), *self.split(right)]) == [left, right]

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a word of any length, each as soon as no later symbol can change it."""
        # tail[room + i] is the last token of the prefix that ends at position base + i; base itself ends an emitted token, or is the word's start ("").
        room = self.lookahead
        tail: list[str | None] = [*[None] * room, ""]
        most, moves, stands, state = 3 * room, self.moves, self.stands, ""
        for s in symbols:
            state, tokens = moves.get(state + s) or self._move(state + s, s)
            for width, token in tokens:  # the longest that stands beside what is before it
                if stands[tail[-width]][token]:
                    tail.append(token)
                    break
            else:
                tail.append(None)
            if len(tail) > most:
                yield from (done := self._stable(tail))
                if done:
                    tail = [*[None] * room, done[-1], *tail[room + 1 + sum(self.width[t] for t in done) :]]
        yield from self._path(tail, len(tail) - 1)

    def _move(self, read: str, symbol: str) -> tuple[str, tuple]:
        """The automaton's next state, and what ends there; read is its state and the symbol."""
        at, last = 0, len(read) - len(symbol)
        while at < last and read[at:] not in self.begins:
            at += 1
        if len(self.moves) >= STATES:
            self.moves.clear()
        self.moves[read] = move = (read[at:], self.ends(read[at:]))
        return move

    def _ends(self, state: str) -> tuple:
        n = self._symbols(state)
        return tuple((n - i, state[i:]) for i in range(n) if state[i:] in self.own)

    def _path(self, tail: list[str | None], at: int) -> list[str]:
        out = []
        while at > self.lookahead:
            out.append(tail[at])
            at -= self.width[tail[at]]
        return out[::-1]

    def _stable(self, tail: list[str | None]) -> list[str]:
        """The tokens that the paths of all of the last `lookahead` positions share."""
        paths = [self._path(tail, i) for i in range(len(tail) - self.lookahead, len(tail)) if tail[i] is not None]
        shared = []
        for tokens in zip(*paths, strict=False):
            if len(set(tokens)) > 1:
                break
            shared.append(tokens[0])
        return shared


class WordBpe:
    """Encoder and decoder of a vocabulary file with word ends: NFC, white space dropped, lower case, byte letters."""

    #: The tokens of words of up to this many symbols are kept for when they come again.
    SHORT = 64
    #: Characters of a text that are split at a time, about, and words, or tokens of a long word, that wait for the digests.
    BLOCK, WAITING = 1 << 16, 4096

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(self.vocab, merges, model["end_of_word_suffix"] or "")
        self.token = {i: t for t, i in (self.vocab | self.added).items()}
        self.letters = byte_letters()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.patterns = [re.compile(split.replace(r"\s", SPACE[1:-2]).replace(r"\p{L}", ranges("L", last)).replace(r"\p{N}", ranges("N", last))) for last in LASTS]
        self.high = re.compile("[\U00010000-\U0010ffff]")
        self.gap = re.compile(SPACE)
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.bytes_of = {c: b for b, c in self.letters.items()}
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.number = {i: str(i) for i in self.token}
        self.cache: Kept = Kept(CACHE_ENTRIES)  # by word: ids and decoded ids
        self.words: Kept = Kept(CACHE_ENTRIES)  # by word: its tokens

    def word(self, word: str) -> Iterable[str]:
        """Tokens of a word, from the transducer; of a long one each as soon as it is stable."""
        if (known := self.words[word]) is not None:
            return known
        known = self._streamed(word)
        if len(word) <= self.SHORT:
            known = tuple(known)
            self.words.put(word, known)
        return known

    def _streamed(self, word: str) -> Iterator[str]:
        data = word.encode("utf-8")
        if len(data) > self.SHORT:
            return self.merges.stream(self._symbols(data))
        letters = data.decode("latin-1").translate(self.letters)
        return self.merges.stream([*letters[:-1], letters[-1] + self.merges.end])

    def _symbols(self, data: bytes) -> Iterator[str]:
        last = len(data) - 1
        for i, b in enumerate(data):
            yield self.letters[b] if i < last else self.letters[b] + self.merges.end

    def chunk_tokens(self, chunk: str) -> Iterable[str]:
        """Tokens of a text without white space or added tokens."""
        return chain.from_iterable(map(self.word, self.split(self.normalised(chunk))))

    def split(self, text: str) -> Iterable[str]:
        """The words of a normalised text, by the pattern for the characters that it has."""
        pattern = self.patterns[0 if text.isascii() else 2 if self.high.search(text) else 1]
        return pattern.findall(text) if len(text) <= 2 * self.BLOCK else (m[0] for m in pattern.finditer(text))

    def normalised(self, text: str) -> str:
        return text.lower() if text.isascii() else self.normal.normalize_str(text)

    def chunks(self, text: str) -> Iterator[str]:
        """Added tokens and what lies between white space, in order."""
        return chain.from_iterable(self.blocks(text))

    def blocks(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text, block by block."""
        for block in self.cuts(text):
            yield [block] if block in self.added else [*filter(None, self.gap.split(block))]

    def cuts(self, text: str) -> Iterator[str]:
        """Added tokens and blocks of what lies between them, which begin and end at white space or there."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._plain(text, at, m.start())
            yield m[0]
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[str]:
        while at < end:
            found = self.gap.search(text, at + self.BLOCK, end)
            to = found.start() if found else end
            yield text[at:to]
            at = found.end() if found else end

    def ids(self, chunk: str) -> Iterator[int]:
        """Ids of a chunk, one at a time."""
        return iter((self.added[chunk],)) if chunk in self.added else map(self.vocab.__getitem__, self.chunk_tokens(chunk))

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks(text) for i in self.ids(chunk)]

    def decode(self, ids: Iterable[int]) -> str:
        """What the library's decode gives for a file without decoder: the tokens, a space between two."""
        return " ".join(map(self.token.__getitem__, ids))

    def decode_text(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text, piece by piece: bytes of tokens through a UTF-8 state machine, a space at each word's end."""
        machine, end = codecs.getincrementaldecoder("utf-8")("replace"), self.merges.end
        for i in ids:
            token = self.token[i]
            if token in self.added:
                yield machine.decode(b"", True) + token
                continue
            last = bool(end) and token.endswith(end)
            piece = machine.decode(bytes(self.bytes_of[c] for c in (token[: -len(end)] if last else token)), last)
            yield piece + " " if last else piece

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them; part by part, no list of all ids."""
        count, ids_hash, text_hash, lead = 0, hashlib.sha256(), hashlib.sha256(), b""
        for known in self._known(text):
            ids = b" ".join([k[0] for k in known])
            count += ids.count(b" ") + 1
            ids_hash.update(lead + ids)
            text_hash.update(lead + b" ".join([k[1] for k in known]))
            lead = b" "
        return count, ids_hash.hexdigest(), text_hash.hexdigest()

    def _known(self, text: str) -> Iterator[list[tuple[bytes, bytes]]]:
        """Ids and decoded ids of the words of a text, some words at a time; of a long word in parts."""
        cache = self.cache
        for block in self.cuts(text):
            if block in self.added:
                yield [self._encoded([self.added[block]])]
                continue
            found = iter(self.split(self.normalised(block)))
            while words := [*islice(found, self.WAITING)]:
                kept, done = [*map(cache.__getitem__, words)], 0
                for i in [i for i, known in enumerate(kept) if known is None]:
                    word = words[i]
                    if (known := cache.get(word)) is None:  # else met in this block
                        ids = map(self.vocab.__getitem__, self._streamed(word))
                        if len(word) <= self.SHORT:
                            cache.put(word, known := self._encoded([*ids]))
                        else:
                            if done < i:
                                yield kept[done:i]
                            while part := [*islice(ids, self.WAITING)]:
                                yield [self._encoded(part)]
                            done = i + 1
                    kept[i] = known
                if done < len(kept):
                    yield kept[done:] if done else kept

    def _encoded(self, ids: list[int]) -> tuple[bytes, bytes]:
        return " ".join(map(self.number.__getitem__, ids)).encode(), self.decode(ids).encode()


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode and decode every whole text; a row for each row of docs.

    docs has doc_id and text; other columns are ignored. A null text is empty: no tokens, digests of nothing. Repeated rows give
    repeated rows, a null doc_id stays null, an empty table gives no rows. One narrow pass, no shuffle.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        for batch in batches:
            values = batch.column("text")
            rows = [bpe.digests(values[i].as_py()) for i in range(len(values))]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], schema=ARROW)

    return texts(docs).mapInArrow(run, SCHEMA)
