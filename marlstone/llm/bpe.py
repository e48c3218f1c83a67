"""BPE encoding and decoding as streams.

The encoder takes a piece's symbols one at a time. What a symbol to come can
still change lies within the merge list's sufficient lookahead, which is
computed once; tokens that end before it are stable and are put out, so memory
is bounded by the lookahead whatever a piece's length. The decoder is a state
machine over the tokens' bytes that puts out text as soon as it is whole. Texts
pass through both in runs, and digests are fed run by run.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from marlstone.llm.batches import small_batches

#: Distinct words, and pieces, kept in each of the two generations of a worker's memory.
REMEMBERED = 200_000
#: A text is encoded in runs of about so many characters.
CHUNK = 1 << 16
#: Words from this length on are not remembered.
LONG_WORD = 200
#: Pieces up to this many symbols are merged by a plain search for the least rank, longer ones with a heap.
SHORT = 48

ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+|[\x1c-\x1f]+", re.ASCII)
ANY_CASE_PIECES = re.compile(ASCII_PIECES.pattern, re.ASCII | re.IGNORECASE)
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]")
#: Letters below this are the same in every edition of Unicode in use.
LATIN_END = "\u0250"
LATIN_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|[\x1c-\x1f]+")
#: What str.split takes for white space and the tokenizer's \s does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """How many symbols after a token's end can still change it.

    A merge (u, v) is lost or gained by what follows only through v: if v is
    taken by an earlier merge that it starts, or made by one. That merge
    depends in the same way on what follows it. Ranks fall along such a chain,
    so the longest one is found in one pass by rank, and each link reaches one
    token further.
    """
    longest: dict[str, int] = {}
    depth = 0
    for u, v in merges:
        here = 1 + longest.get(v, 0)
        depth = max(depth, here)
        for token in (u, u + v):
            longest[token] = max(longest.get(token, 0), here)
    return (depth + 1) * max((len(u) + len(v) for u, v in merges), default=1)


LETTERS = byte_letters()
BYTES = {letter: b for b, letter in LETTERS.items()}


def _unfinished(data: bytes) -> int:
    """How many bytes at the end have begun a UTF-8 sequence that may go on."""
    for back in range(1, min(3, len(data)) + 1):
        lead = data[-back]
        if lead >= 0xC0:
            return back if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else 0
        if lead < 0x80:
            break
    return 0


class Vocabulary:
    """A tokenizer file of the tokenizers library, of kind BPE over byte letters with a mark at word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain BPE over byte letters is read")
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.end = model.get("end_of_word_suffix") or ""
        self.lookahead = sufficient_lookahead(merges)
        self.added = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.mark = commonprefix(list(self.added))
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.tokens = {i: t for t, i in (self.ids | self.added).items()}
        self.decimal = {i: f" {i}".encode() for i in self.tokens}
        if whole.get("decoder") is not None:
            raise ValueError("only files without a decoder are read")
        self.named = {i: f" {t}".encode() for i, t in self.tokens.items()}
        self.whole = {i: b.decode() for i, b in self.named.items() if not _unfinished(b)}  # these leave the decoder's state as it is
        self.restored = {i: self._restored(t) for i, t in self.tokens.items()}
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer

    def _restored(self, token: str) -> bytes:
        """The bytes that a token was made from, and a blank at a word's end."""
        if token in self.added:
            return token.encode()
        ends = bool(self.end) and token.endswith(self.end)
        return bytes(BYTES[c] for c in (token[: -len(self.end)] if ends else token)) + b" " * ends

    def pieces(self, word: str) -> Iterable[str]:
        """The pieces of a word without white space, in byte letters; none reaches into another.

        Letters beyond Latin ones are normalized and classed by the library,
        whose edition of Unicode decides.
        """
        if word.isascii():
            return ASCII_PIECES.findall(word.lower()) if word.isprintable() else map(_in_letters, ASCII_PIECES.findall(word.lower()))
        if max(word) < LATIN_END and unicodedata.is_normalized("NFC", word):
            return map(_in_letters, LATIN_PIECES.findall(word.lower()))
        return (x for x, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(word)))


def _in_letters(text: str) -> str:
    return "".join(LETTERS[b] for b in text.encode())


def merged(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The tokens that the merge list makes of symbols: the pair of least rank, and of these the first, becomes one, again and again."""
    if len(parts) > SHORT:
        return _merged_long(parts, ranks)
    none, get = len(ranks), ranks.get
    found = [get(p, none) for p in zip(parts, parts[1:])]  # noqa: B905
    while found:
        least = min(found)
        if least == none:
            break
        i = found.index(least)
        parts[i] += parts.pop(i + 1)
        del found[i]
        if i:
            found[i - 1] = get((parts[i - 1], parts[i]), none)
        if i < len(found):
            found[i] = get((parts[i], parts[i + 1]), none)
    return parts


def _merged_long(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    n = len(parts)
    tokens, after, before = list(parts), [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get((a, b))) is not None]  # noqa: B905
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if tokens[i] != a or j < 0 or tokens[j] != b:
            continue
        tokens[i], tokens[j] = a + b, ""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
            if (r := ranks.get((a + b, tokens[after[j]]))) is not None:
                heapq.heappush(heap, (r, i, a + b, tokens[after[j]]))
        if before[i] >= 0 and (r := ranks.get((tokens[before[i]], a + b))) is not None:
            heapq.heappush(heap, (r, before[i], tokens[before[i]], a + b))
    return [t for t in tokens if t]


class Transducer:
    """Symbols in, ids out, with at most twice the lookahead held."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.held, self.size = vocabulary, [], 0

    def feed(self, symbols: str) -> list[int]:
        """The ids that are stable after ``symbols``."""
        step, out = self.v.lookahead, []
        for at in range(0, len(symbols), step):
            self.held += symbols[at : at + step]
            self.size += min(step, len(symbols) - at)
            if self.size > 2 * step:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        # the last symbol is held back from merging, as it may yet turn out to end the piece
        sure, done, out = self.size - self.v.lookahead - 1, 0, []
        for token in merged(self.held[:-1], self.v.ranks):
            if done + len(token) > sure:
                break
            done += len(token)
            out.append(self.v.ids[token])
        del self.held[:done]
        self.size -= done
        return out

    def finish(self) -> list[int]:
        """The ids of what is held, as the piece ends here."""
        held, self.held, self.size = self.held, [], 0
        if held:
            held[-1] += self.v.end
        return [self.v.ids[token] for token in merged(held, self.v.ranks)]


class Memory:
    """What was made of strings, the latest REMEMBERED to twice as many of them."""

    def __init__(self) -> None:
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def put(self, key: str, value: tuple) -> None:
        if len(self.young) >= REMEMBERED:
            self.old.clear()
            self.old.update(self.young)  # both dicts stay the same objects
            self.young.clear()
        self.young[key] = value


class Decoder:
    """Ids in, text out: a state machine over bytes.

    A token is a string of bytes. Where the tokenizer's file names no decoder,
    the library's decoding is the tokens' names with blanks between, so the
    bytes are a blank and the name's UTF-8. With ``restore`` they are those
    that were encoded: byte letters stand for bytes, and a word's end for a
    blank. A UTF-8 sequence that has begun is held until it is whole, so the
    state is whether anything was put out, and three bytes at most.
    """

    def __init__(self, vocabulary: Vocabulary, restore: bool = False) -> None:
        self.bytes_of = vocabulary.restored if restore else vocabulary.named
        self.whole = {} if restore else vocabulary.whole
        self.blank = not restore
        self.begun, self.pending = False, b""

    def push(self, token: int) -> str:
        """The text that is whole after ``token``; ids that are not in the vocabulary add none."""
        if self.begun and not self.pending and token in self.whole:
            return self.whole[token]
        data = self.bytes_of.get(token)
        if data is None:
            return ""
        if not self.begun:
            self.begun = True
            data = data[1:] if self.blank else data
        data = self.pending + data
        held = _unfinished(data)
        whole, self.pending = (data[:-held], data[-held:]) if held else (data, b"")
        return whole.decode("utf-8", "replace")

    def finish(self) -> str:
        """What is held, as no more tokens come."""
        text, self.pending = self.pending.decode("utf-8", "replace"), b""
        return text


#: What a run of ids comes to: their number, themselves in decimal and the text they decode to, each id with a blank before it.
Said = tuple[int, bytes, bytes]


class Encoder:
    """Ids of texts, run by run, and what they decode to.

    Words, cut at white space, and their pieces are independent of each other,
    and after a whole word's tokens the decoder's state is always the same. So
    what the machines make of a word is remembered with it.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.words, self.known_pieces = vocabulary, Memory(), Memory()
        self.decoder = Decoder(vocabulary)
        self.decoder.begun = True  # as it is amid a text

    def _piece(self, piece: str) -> tuple[int, ...]:
        memory = self.known_pieces
        ids = memory.young.get(piece) or memory.old.get(piece)
        if ids is None:
            stream = Transducer(self.v)
            ids = (*stream.feed(piece), *stream.finish())
            if len(piece) < LONG_WORD:
                memory.put(piece, ids)
        return ids

    def _word(self, word: str) -> list[int]:
        v, out = self.v, []
        for part in v.split_added.split(word) if v.split_added and v.mark in word else (word,):
            if part in v.added:
                out.append(v.added[part])
            elif part:
                for piece in v.pieces(part):
                    out += self._piece(piece)
        return out

    def _long(self, text: str, begin: int, end: int) -> Iterator[Sequence[int]]:
        """Ids of text[begin:end], one word of ASCII; no piece of it is held as a whole."""
        added = self.v.split_added.finditer(text, begin, end) if self.v.split_added else ()
        for a, b, ids in chain(((m.start(), m.end(), (self.v.added[m[0]],)) for m in added), [(end, end, ())]):
            for m in ANY_CASE_PIECES.finditer(text, begin, a):
                stream = Transducer(self.v)
                for at in range(m.start(), m.end(), self.v.lookahead):
                    yield stream.feed(_in_letters(text[at : min(at + self.v.lookahead, m.end())].lower()))
                yield stream.finish()
            begin = b
            yield ids

    def _said(self, ids: Sequence[int]) -> Said:
        """``ids`` as both machines put them out amid a text."""
        decimal, push = self.v.decimal, self.decoder.push
        text = "".join([push(i) for i in ids]) + (self.decoder.finish() if self.decoder.pending else "")
        return len(ids), b"".join([decimal[i] for i in ids]), text.encode()

    def word(self, word: str) -> Said:
        said = self.words.old.get(word)
        if said is None:
            said = self._said(self._word(word))
        if len(word) < LONG_WORD:
            self.words.put(word, said)
        return said

    def runs(self, text: str) -> Iterator[Said]:
        """What a text's words come to, in order, in runs of about CHUNK characters.

        Besides ``text`` and what is remembered, about a run is held, and of
        an ASCII word of any length twice the lookahead. A word beyond ASCII is
        normalized as a whole.
        """
        get, word, at = self.words.young.get, self.word, 0
        while at < len(text):
            end = at + CHUNK
            if end < len(text):
                space = SPACE.search(text, end)
                end = space.start() if space else len(text)
            if end - at > 2 * CHUNK:
                # a long word ends the run: what comes before it is a run of its own
                begin = max((m.end() for m in SPACE.finditer(text, at, at + CHUNK)), default=at)
                if not BEYOND_ASCII.search(text, begin, end):
                    if begin > at:
                        yield self._run(text[at:begin], get, word)
                    for ids in self._long(text, begin, end):
                        if ids:
                            yield self._said(ids)
                    at = end
                    continue
            yield self._run(text[at:end] if at or end < len(text) else text, get, word)
            at = end

    def _run(self, text: str, get, word) -> Said:
        words = text.split() if not ODD_SPACE.search(text) else [w for w in SPACE.split(text) if w]
        known = [get(w) for w in words]
        if None in known:
            known = [word(w) if k is None else k for w, k in zip(words, known, strict=True)]
        if not known:
            return 0, b"", b""
        counts, listed, decoded = zip(*known, strict=True)
        return sum(counts), b"".join(listed), b"".join(decoded)

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        return [int(i) for _, listed, _ in self.runs(text) for i in listed.split()]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One for each worker process, which keeps it from task to task."""
    return Encoder(Vocabulary(path))


#: Rows are taken from a batch in slices of about so many characters.
SLICE_CHARS = 1 << 20


def encode(df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Ids and decoded text of each whole text: (id_column, n_tokens, ids, decoded).

    With ``digests``: (id_column, n_tokens, ids_sha256, decoded_sha256) in place
    of these. ``path`` is the tokenizer's file, which executors read from their
    own installation. A null text counts as empty, which has no tokens. Rows
    are independent: no shuffle, and no row is joined with another.
    """
    small_batches(df.sparkSession)
    key = df.schema[id_column].dataType.simpleString()
    out = f"`{id_column}` {key}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        rest = [("n_tokens", pa.int64()), *([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())])]

        def pack(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), rest, strict=True)]
            return pa.RecordBatch.from_arrays([keys, *columns], schema=pa.schema([(id_column, keys.type), *rest]))

        def one(text: str) -> tuple:
            n, shas, parts = 0, (hashlib.sha256(), hashlib.sha256()), ([], [])
            for count, *said in encoder.runs(text):
                for sha, held, more in zip(shas, parts, said, strict=True):
                    more = memoryview(more)[0 if n else 1 :]  # no blank before the first
                    sha.update(more) if digests else held.append(more)
                n += count
            if digests:
                return n, *(sha.hexdigest() for sha in shas)
            return n, [int(i) for i in b"".join(parts[0]).split()], b"".join(parts[1]).decode()

        for batch in batches:
            begun, rows, size = 0, [], 0
            for i, value in enumerate(batch.column(1)):
                rows.append(one(value.as_py() or ""))
                size += 200 if digests else len(rows[-1][2])
                if size > SLICE_CHARS:
                    yield pack(batch.column(0).slice(begun, i + 1 - begun), rows)
                    begun, rows, size = i + 1, [], 0
            if rows:
                yield pack(batch.column(0).slice(begun), rows)

    return df.select(id_column, text).mapInArrow(run, out)
