"""Byte-pair encoding as a bounded-lookahead streaming transducer, and an incremental decoder.

Merges are applied in rank order. How far back a difference in what follows can reach is bounded by the merge list alone:
a token to the right of the last agreed boundary can pull the token before it across that boundary, at most once per
rule and only with rules of rising rank. ``sufficient_lookahead`` follows those chains and returns the bound L. The
transducer takes the bytes of a word as they come and keeps a buffer of bounded length: tokens that end L or more symbols
before the buffer's end are stable and are emitted, and encoding goes on after the last of them. The end of a word
flushes it, so between words its state is empty; what the transducer has made of a whole word from that state is
remembered (``MEMO`` words), as a transition of its own. Texts are read in slices, which may end inside a word. Beside a text
and its ids, memory is bounded by L and the slice, whatever the length of text or word.

Vocabularies come as ``tokenizers`` JSON files whose path is a parameter; the driver reads the file and broadcasts the
tables (their size is that of the vocabulary, not of the data).

Defined results: a null text is an empty one and has no tokens. Strings of special tokens in a text become those tokens.
Rows are independent, so repeated rows and null ids need no care; an empty table gives an empty result. A column that has the
name of an output column is replaced. Slices end before white space, or in a run of ASCII letters, digits or punctuation, Han
or kana; a text that has none of these for long is a longer slice. Letters and numbers are those of Unicode 16; combining marks that
came with it are put in order by Python's older tables.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import re
import struct
import sys
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import map_texts, read_table

#: Words kept in a worker's memo; beyond, it starts anew.
MEMO = 300_000
#: Characters of a text that are taken at a time.
SLICE = 1 << 16
#: Ids that a decoder is fed at a time.
FEED = 4096
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
# The white space of Unicode.
_WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters and numbers that Unicode 16 added to 15.1, and capitals with what they become (range, distance).
_NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
_NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
_NEW_CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
_LOWER = {c: c + by for first, last, by in _NEW_CAPITALS for c in range(first, last + 1)} | {ord("Σ"): ord("σ")}
_ODD_CAPITAL = re.compile("[" + "".join(map(chr, _LOWER)) + "]")
_PUNCTUATION = r"!-&(-/:-@\[-`{-~"
#: Where a slice may end: before white space, or (the one group) inside a run that makes one word.
_CUT = re.compile(rf"(?=[\t-\r ])|(?<=[0-9])(?=[0-9])|(?=((?<=[a-zA-Z]{{4}})[a-zA-Z]|(?<=[{_PUNCTUATION}]{{4}})[{_PUNCTUATION}]|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff]{{4}})[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff]))")


def _ranges(codes: list[int]) -> str:
    """A regular expression's class of code points, without its brackets."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in out)


@functools.cache
def word_pattern(top: int) -> re.Pattern:
    """Words of a lower-case text whose code points are at most ``top``."""
    classes = []
    for kind, more in (("L", _NEW_LETTERS), ("N", _NEW_NUMBERS)):
        new = {c for a, b in more for c in range(a, b + 1)}
        classes.append(_ranges([c for c in range(top + 1) if unicodedata.category(chr(c))[0] == kind or c in new]))
    letters, numbers = classes
    return re.compile(f"{_CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{_WHITE}{letters}{numbers}]+")


def words_of(text: str) -> list[str]:
    """The words of a text, or of a slice of one, in lower case."""
    if text.isascii():
        return word_pattern(0xFF).findall(text.lower())
    text = unicodedata.normalize("NFC", text)
    if _ODD_CAPITAL.search(text):
        text = text.translate(_LOWER)
    text = text.lower()
    top = ord(max(text)) if text else 0
    return word_pattern(0xFF if top <= 0xFF else 0xFFFF if top <= 0xFFFF else sys.maxunicode).findall(text)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    table = {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Vocabulary:
    """Tables of a byte-level BPE with word ends."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for piece, i in [*ids.items(), *self.special.items()]:
            self.pieces[i] = piece
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.last = [ids[s + self.suffix] for s in symbols]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(ids[a] << 20 | ids[b], rank << 20 | ids[a + b])
        self.sizes = [max(1, len(p.removesuffix(self.suffix)) if self.suffix else len(p)) for p in self.pieces]
        of, names = {s: b for b, s in enumerate(symbols)}, set(self.special)
        self.ends = [p in names or bool(self.suffix) and p.endswith(self.suffix) for p in self.pieces]
        #: Bytes of each piece, with the space that follows a word or a special token.
        self.raw = [p.encode() + b" " if p in names else bytes(of[c] for c in p.removesuffix(self.suffix)) + b" " * end for p, end in zip(self.pieces, self.ends, strict=True)]


def sufficient_lookahead(vocabulary: Vocabulary) -> int:
    """Symbols that suffice to the right of a token for it to be final.

    reach[t]: how far left of the end of what was read the last agreed boundary may lie while t stands right of it in
    one of two continuations. Taking the rules by rank, (x, y) can move the boundary over x where y stands right of it;
    then x y stands there in one continuation and x in the other. A token there can also grow to its right.
    """
    reach = [0] * len(vocabulary.pieces)
    for key, rule in sorted(vocabulary.merges.items(), key=lambda kv: kv[1]):
        x, y, made = key >> 20, key & 0xFFFFF, rule & 0xFFFFF
        moved = vocabulary.sizes[x] + reach[y]
        reach[made] = max(reach[made], reach[x], moved)
        reach[x] = max(reach[x], moved)
    return max(reach) + max(vocabulary.sizes)


_NONE = 1 << 62


def merge_all(symbols: list[int], merges: dict) -> list[int]:
    """Apply the merges in rank order, leftmost first. ``merges`` maps a pair (first << 20 | second) to rank << 20 | made."""
    if len(symbols) > 64:
        return _merge_long(symbols, merges)
    get = merges.get
    ranks = [get(a << 20 | b, _NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
    n = len(ranks)
    while n:
        best = min(ranks)
        if best == _NONE:
            break
        i = ranks.index(best)
        made = best & 0xFFFFF
        symbols[i] = made
        del symbols[i + 1], ranks[i]
        n -= 1
        if i:
            ranks[i - 1] = get(symbols[i - 1] << 20 | made, _NONE)
        if i < n:
            ranks[i] = get(made << 20 | symbols[i + 1], _NONE)
    return symbols


def _merge_long(symbols: list[int], merges: dict) -> list[int]:
    """The same with a heap of (rank, place) over a linked list."""
    n = len(symbols)
    sym, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        if i >= 0 and nxt[i] < n:
            m = merges.get(sym[i] << 20 | sym[nxt[i]])
            if m is not None:
                heapq.heappush(heap, (m >> 20, i, sym[i], sym[nxt[i]], m & 0xFFFFF))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = nxt[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = made, -1
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        offer(prv[i])
        offer(i)
    return [s for s in sym if s >= 0]


class _Memo(dict):
    """What a function makes of words, forgotten when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        out = self.make(word)
        if len(word) <= 40:
            if len(self) >= MEMO:
                self.clear()
            self[word] = out
        return out


class Transducer:
    """Encodes with one vocabulary. ``feed`` takes bytes of a word and returns the ids that are stable, ``finish`` ends the word."""

    def __init__(self, vocabulary: Vocabulary, lookahead: int):
        self.v, self.lookahead = vocabulary, lookahead
        self.room = lookahead + 2 * max(vocabulary.sizes) + 64
        self.buffer: list[int] = []
        self.final = 0
        self.memo = _Memo(self.word)
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) + ")") if vocabulary.special else None

    def feed(self, data: bytes) -> list[int]:
        """Take more bytes of a word."""
        if not data:
            return []
        inner, sizes, buffer, out, at = self.v.inner, self.v.sizes, self.buffer, [], 0
        buffer += [inner[b] for b in data]
        self.final = data[-1]
        while len(buffer) - at > self.room:  # the last symbol waits for what comes: it may be the word's last
            ends = at + self.room - self.lookahead
            for token in merge_all(buffer[at : at + self.room], self.v.merges):
                if at + sizes[token] > ends:
                    break
                at += sizes[token]
                out.append(token)
        del buffer[:at]
        return out

    def finish(self) -> list[int]:
        """End the word."""
        if not self.buffer:
            return []
        self.buffer[-1] = self.v.last[self.final]
        out, self.buffer = merge_all(self.buffer, self.v.merges), []
        return out

    def word(self, word: str) -> bytes:
        ids = self.feed(word.encode("utf-8", "surrogatepass")) + self.finish()
        return struct.pack(f"<{len(ids)}i", *ids)

    def plain(self, text: str):
        """Ids, as little-endian 32-bit integers, of a stretch without special tokens, slice by slice."""
        at, inside = 0, False
        while at < len(text):
            cut = _CUT.search(text, at + SLICE) if at + SLICE < len(text) else None
            end, goes_on = (cut.start(), cut[1] is not None) if cut else (len(text), False)
            words = words_of(text[at:end])
            if inside:  # the first word began in the last slice
                ids = self.feed(words[0].encode("utf-8", "surrogatepass"))
                ids += self.finish() if words[1:] or not goes_on else []
                yield struct.pack(f"<{len(ids)}i", *ids)
                del words[0]
            last = words.pop() if goes_on and words else ""
            yield b"".join(map(self.memo.__getitem__, words))
            if last:
                ids = self.feed(last.encode("utf-8", "surrogatepass"))
                yield struct.pack(f"<{len(ids)}i", *ids)
            at, inside = end, goes_on

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if self.split is None or not any(s in text for s in self.v.special):
            return b"".join(self.plain(text))
        out = []
        for k, part in enumerate(self.split.split(text)):
            out += [struct.pack("<i", self.v.special[part])] if k % 2 else self.plain(part)
        return b"".join(out)


class Decoder:
    """Turns ids into text, some at a time: keeps the bytes of an unfinished character and whether a space is due.

    With ``pieces`` the vocabulary's own strings come out with a space between them, as a tokenizer file without a decoder asks for.
    """

    def __init__(self, vocabulary: Vocabulary, pieces: bool = False):
        self.v, self.pieces = vocabulary, pieces
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.due = False

    def feed(self, ids: list[int], final: bool = False) -> str:
        if self.pieces:
            joined = " ".join([self.v.pieces[i] for i in ids])
            due, self.due = self.due and len(ids) > 0, self.due or len(ids) > 0
            return " " + joined if due else joined
        raw = self.v.raw
        data = (b" " if self.due and len(ids) else b"") + b"".join([raw[i] for i in ids])
        if len(ids):
            self.due = self.v.ends[ids[-1]]
            data = data[:-1] if self.due else data
        return self.state.decode(data, final)


_OPEN: dict[int, Transducer] = {}


def _transducer(shared) -> Transducer:
    """One transducer for each worker and vocabulary."""
    source, lookahead = shared.value
    key = hash(source)
    if key not in _OPEN:
        _OPEN[key] = Transducer(Vocabulary(source), lookahead)
    return _OPEN[key]


def _share(spark: SparkSession, path: str):
    source = Path(path).read_text(encoding="utf-8")
    return spark.sparkContext.broadcast((source, sufficient_lookahead(Vocabulary(source))))


def _texts_of(v: Vocabulary, values: np.ndarray, offsets: np.ndarray, pieces: bool) -> pa.Array:
    """Decoded text of each stretch of ids, fed to a decoder ``FEED`` ids at a time."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        decoder = Decoder(v, pieces)
        parts = [decoder.feed(values[at : min(at + FEED, b)].tolist()) for at in range(a, b, FEED)]
        out.append("".join([*parts, decoder.feed([], True)]))
    return pa.array(out, pa.string())


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", into: str = "ids", decoded: str | None = None, pieces: str | None = None) -> DataFrame:
    """Add the token ids of a text as array<int>; other columns stay.

    ``decoded`` and ``pieces`` name columns for what is decoded from them again: text, or the vocabulary's strings.
    """
    shared = _share(docs.sparkSession, vocabulary_path)
    more = {name: kind for name, kind in ((decoded, False), (pieces, True)) if name}
    rest = docs.drop(*({into, *more} - {text}))
    names = rest.columns
    if text in {into, *more}:
        raise ValueError("an output column has the text's name")

    def run(table: pa.Table):
        t = _transducer(shared)
        coded = [t.encode(x) if x else b"" for x in table.column(names.index(text)).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
        values = np.frombuffer(b"".join(coded), "<i4")
        out = table.append_column(into, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
        for name, kind in more.items():
            out = out.append_column(name, _texts_of(t.v, values, offsets, kind))
        yield from out.combine_chunks().to_batches()

    schema = StructType([*rest.schema.fields, StructField(into, ArrayType(IntegerType())), *(StructField(name, StringType()) for name in more)])
    return map_texts(rest, run, schema, 200)


def decode(coded: DataFrame, vocabulary_path: str, ids: str = "ids", into: str = "decoded", pieces: bool = False) -> DataFrame:
    """Replace ids by text; null ids are none. With ``pieces`` the vocabulary's own strings are joined by a space, as a tokenizer file without a decoder asks for."""
    shared = _share(coded.sparkSession, vocabulary_path)
    rest = coded.drop(into) if into != ids else coded

    def run(table: pa.Table):
        column = table.column(ids).combine_chunks().fill_null([])
        offsets = column.offsets.to_numpy()
        texts = _texts_of(_transducer(shared).v, column.flatten().to_numpy(), offsets - offsets[0], pieces)
        yield from table.drop_columns([ids]).append_column(into, texts).combine_chunks().to_batches()

    return map_texts(rest, run, rest.drop(ids).schema.add(into, "string"), 200)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids, of what the file's decoding makes of them, and of the text decoded byte by byte, for every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, vocabulary_path(), decoded="plain", pieces="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    digest = lambda c, name: F.sha2(c, 256).alias(name)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(ids, "ids_sha256"), digest("decoded", "decoded_sha256"), digest("plain", "plain_sha256"))
