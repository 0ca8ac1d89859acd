"""SentencePiece encoding with source offsets, and decoding.

A text is normalised from left to right: at each place the longest prefix that the model's compiled character map knows is
replaced by what the map has for it, any other character stands for itself (a model with an empty map, such as an identity
one, has only these), spaces become U+2581, and a dummy prefix may come first. Each step records where in the source it
began, so every boundary of normalised text has a byte offset of the original, and every piece a span of original bytes.

Pieces are merged by score, leftmost first. No merge crosses a boundary whose two characters are in no piece side by side; so
texts are cut where U+2581 follows another character (if no piece has that) and around characters that no longer piece
holds, and such stretches at all other boundaries of the kind. What a worker made of a stretch, and of a part of one, is
remembered (``MEMO`` of each). Characters that are no piece become
bytes, or the unknown piece. Decoding feeds ids to a state machine that keeps an unfinished character's bytes.

The model file's path is a parameter; the driver reads it and broadcasts it (its size is the vocabulary's, not the data's).

Defined results: a null text is an empty one, with no pieces but the end id where that is asked for; repeated rows and null ids
need no care, since rows are independent; an empty table gives an empty result; a column with the name of an output column is
replaced. A text is worked on whole, a long stretch without a cut with a heap, in n log n steps. Models whose pieces are not merged
by score (unigram), or with user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from operator import add
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import map_texts, read_table

#: Stretches, and parts of them, kept in a worker's memos; beyond, a memo starts anew.
MEMO = 300_000
#: Ids that a decoder is fed at a time.
FEED = 4096
SPACE = "▁"
# Fixed values of the model file format: kinds of pieces, and the text of the unknown piece.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_UNKNOWN_TEXT = " ⁇ "
_NONE = 1 << 62


def _each_bad_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("tripforge.each-byte", _each_bad_byte)


class CharacterMap:
    """The compiled map of a model: a double array over the bytes of source prefixes, and the texts it leads to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size :]
        self.memo: dict[int, str] = {}
        #: First bytes of the prefixes it knows: at any other character nothing needs to be looked up.
        self.first = {b for b in range(1, 256) if self._child(self._root(), b) is not None} if self.units else set()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _root(self) -> int:
        return self._offset(self.units[0])

    def _child(self, node: int, byte: int) -> int | None:
        at = node ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, source: bytes, at: int) -> tuple[int, str] | None:
        """Length and replacement of the longest known prefix of the source from a place, if any."""
        if source[at] not in self.first:
            return None
        node, found = self._root(), None
        for end in range(at, len(source)):
            child = self._child(node, source[end])
            if child is None:
                break
            unit = self.units[child]
            node = child ^ self._offset(unit)
            if unit >> 8 & 1:
                found = end + 1 - at, self.units[node] & 0x7FFFFFFF
        return (found[0], self._text(found[1])) if found else None

    def _text(self, at: int) -> str:
        if at not in self.memo:
            self.memo[at] = self.texts[at : self.texts.index(b"\0", at)].decode()
        return self.memo[at]


class Model:
    """Tables of a piece model whose merges go by score."""

    def __init__(self, source: bytes):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(source)
        kinds = {p.type for p in spec.pieces}
        if spec.trainer_spec.model_type != 2 or kinds & {USER_DEFINED, UNUSED} or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that merge by score, without user-defined or unused pieces, are known")
        if spec.denormalizer_spec.precompiled_charsmap:
            raise ValueError("a map for decoded texts is not known")
        rule = spec.normalizer_spec
        self.map = CharacterMap(rule.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = rule.add_dummy_prefix, rule.remove_extra_whitespaces, rule.escape_whitespaces
        self.pieces = [p.piece for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        self.begin, self.end, self.unknown = spec.trainer_spec.bos_id, spec.trainer_spec.eos_id, self.kinds.index(UNKNOWN)
        self.bytes = [-1] * 256
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.bytes[int(self.pieces[i][1:-1], 16)] = i
        self.fallback = spec.trainer_spec.byte_fallback
        ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        scores = sorted({-spec.pieces[i].score for i in ids.values()})
        rank = {score: k for k, score in enumerate(scores)}
        self.ids, self.ranks = ids, {p: rank[-spec.pieces[i].score] for p, i in ids.items() if len(p) > 1}
        self.unknown_text = spec.trainer_spec.unk_surface or _UNKNOWN_TEXT
        self.controls = {i for i, kind in enumerate(self.kinds) if kind == CONTROL}
        #: Bytes that each id stands for in a decoded text.
        self.raw = [self._raw(i) for i in range(len(self.pieces))]
        self.stretches = self._stretches()
        #: Neighbours in some piece; no merge joins others.
        self.pairs = {p[k : k + 2] for p in self.ranks for k in range(len(p) - 1)}

    def _raw(self, i: int) -> bytes:
        kind = self.kinds[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        if kind == CONTROL:
            return b""
        return (self.unknown_text if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ")).encode()

    def _stretches(self) -> re.Pattern | None:
        """Stretches that no merge leaves, or None if pieces can hold U+2581 after another character."""
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ranks):
            return None
        held = re.escape("".join(sorted({c for p in self.ranks for c in p} - {SPACE})))
        return re.compile(f"{SPACE}*[{held}]+|{SPACE}+|[^{SPACE}{held}]")

    def merged(self, text: str) -> list[str]:
        """The pieces of normalised text: the best-scored neighbours are joined first, the leftmost of equals."""
        symbols = list(text)
        if len(symbols) > 48:
            return self._merged_long(symbols)
        score = self.ranks.get
        ranks = [score(a + b, _NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            symbols[i] += symbols[i + 1]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = score(symbols[i - 1] + symbols[i], _NONE)
            if i < len(ranks):
                ranks[i] = score(symbols[i] + symbols[i + 1], _NONE)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap of (rank, place) over a linked list."""
        ranks, n = self.ranks, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, str]] = []

        def offer(i: int, j: int) -> None:
            both = symbols[i] + symbols[j]
            if both in ranks:
                heapq.heappush(heap, (ranks[both], i, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != len(both):
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s]


class _Memo(dict):
    """What a function makes of stretches, forgotten when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, part: str) -> bytes:
        out = self.make(part)
        if len(part) <= 40:
            if len(self) >= MEMO:
                self.clear()
            self[part] = out
        return out


class Encoder:
    """Encodes with one model."""

    def __init__(self, model: Model):
        self.m, self.memo, self.parts, self.packed = model, _Memo(self.stretch), _Memo(self.part), _Memo(self._pack)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and the byte of the source at which each of its characters begins (one more for the end)."""
        m, space = self.m, SPACE if self.m.escape else " "
        source = text.encode("utf-8", "surrogatepass")
        if not m.map.units and not m.squeeze:
            codes = np.frombuffer(source, np.uint8)
            starts = np.append(np.flatnonzero((codes & 0xC0) != 0x80), len(source)).astype(np.int32)
            made = text.replace(" ", space)
            return (space + made, np.concatenate([starts[:1], starts])) if m.prefix and text else (made, starts)
        out: list[str] = []
        begins: list[int] = []
        at, spaced = 0, m.squeeze
        while at < len(source):
            found = m.map.longest(source, at)
            if found is None:
                size = 1 + (source[at] >= 0xC0) + (source[at] >= 0xE0) + (source[at] >= 0xF0)
                found = size, source[at : at + size].decode("utf-8", "surrogatepass")
            size, made = found
            if spaced:
                made = made.lstrip(" ")
            if made:
                if not out and m.prefix:
                    out.append(space)
                    begins.append(at if m.squeeze else 0)
                out += made.replace(" ", space)
                begins += [at] * len(made)
                spaced = m.squeeze and made.endswith(" ")
            at += size
        end = at if out else 0
        while m.squeeze and out and out[-1] == space:
            out.pop()
            end = begins.pop()
        return "".join(out), np.array([*begins, end], np.int32)

    def stretch(self, text: str) -> bytes:
        """Pairs of 32-bit integers for a stretch of normalised text: an id, and how many of its characters that stands for."""
        pairs = self.m.pairs
        if pairs.issuperset(map(add, text, text[1:])):
            return self.parts[text]
        cuts = [0, *(k for k, pair in enumerate(map(add, text, text[1:]), 1) if pair not in pairs), len(text)]
        return b"".join([self.parts[text[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)])

    def part(self, text: str) -> bytes:
        """The same for a part without a boundary that no merge crosses."""
        return b"".join(map(self.packed.__getitem__, self.m.merged(text) if len(text) > 1 else text))

    def _pack(self, piece: str) -> bytes:
        """The same for a piece, or for a character that is none."""
        m = self.m
        if piece in m.ids:
            return struct.pack("<2i", m.ids[piece], len(piece))
        if not m.fallback:
            return struct.pack("<2i", m.unknown, len(piece))
        parts = piece.encode("utf-8", "surrogatepass")
        return b"".join([struct.pack("<2i", m.bytes[b], len(piece) if k == len(parts) else 0) for k, b in enumerate(parts, 1)])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text, and the byte offsets of the source at which they begin and, in the second column, end."""
        normal, begins = self.normalise(text)
        parts = self.m.stretches.findall(normal) if self.m.stretches else [normal] if normal else []
        made = np.frombuffer(b"".join(map(self.memo.__getitem__, parts)), "<i4").reshape(-1, 2)
        if not self.m.fallback:
            made = self._join_unknown(made)
        bounds = np.zeros(len(made) + 1, np.int64)
        np.cumsum(made[:, 1], out=bounds[1:])
        where = begins[bounds]
        return made[:, 0], np.stack([where[:-1], where[1:]], axis=1)

    def _join_unknown(self, made: np.ndarray) -> np.ndarray:
        """Unknown pieces that follow each other are one."""
        unknown = made[:, 0] == self.m.unknown
        first = np.flatnonzero(~(unknown & np.concatenate([[False], unknown[:-1]])))
        return np.stack([made[first, 0], np.add.reduceat(made[:, 1], first)], axis=1) if len(made) else made


class Decoder:
    """Turns ids into text, some at a time: keeps the bytes of an unfinished character and whether the text has begun."""

    def __init__(self, model: Model):
        self.m = model
        self.state = codecs.getincrementaldecoder("utf-8")("tripforge.each-byte")
        self.begun = False

    def feed(self, ids: list[int], final: bool = False) -> str:
        if self.m.controls.isdisjoint(ids):
            return self._feed(ids, final)
        out, at = [], 0
        for k, i in enumerate(ids):
            if i in self.m.controls:  # it stands for nothing, but ends a run of bytes
                out.append(self._feed(ids[at:k], True))
                at = k + 1
        return "".join([*out, self._feed(ids[at:], final)])

    def _feed(self, ids: list[int], final: bool) -> str:
        raw, at, head = self.m.raw, 0, b""
        while not self.begun and at < len(ids):  # the dummy prefix is dropped, and more spaces only if they are squeezed
            i, at = ids[at], at + 1
            head, kind = raw[i], self.m.kinds[i]
            if kind == NORMAL and (self.m.prefix or self.m.squeeze) and head.startswith(b" "):
                head = head[1:]
                self.begun = not self.m.squeeze or bool(head)
            else:
                self.begun = bool(head)
        return self.state.decode(head + b"".join([raw[i] for i in ids[at:]]), final)


_OPEN: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each worker and model."""
    source = shared.value
    key = hash(source)
    if key not in _OPEN:
        _OPEN[key] = Encoder(Model(source))
    return _OPEN[key]


def _share(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def _text_of(model: Model, ids: list[int]) -> str:
    decoder = Decoder(model)
    return "".join([decoder.feed(ids[at : at + FEED]) for at in range(0, len(ids), FEED)] + [decoder.feed([], True)])


def encode(docs: DataFrame, model_path: str, text: str = "text", into: str = "ids", spans: str | None = None, begin: bool = False, end: bool = False, decoded: str | None = None) -> DataFrame:
    """Add the piece ids of a text as array<int>, with the model's begin and end ids if asked for; other columns stay.

    ``spans`` names a column array<struct<start, end>> of the original UTF-8 bytes that each id stands for (of a character's
    bytes, the last has them; begin and end ids are empty spans), ``decoded`` one for the text decoded from the ids.
    """
    shared = _share(docs.sparkSession, model_path)
    added = [c for c in (into, spans, decoded) if c]
    if text in added:
        raise ValueError("an output column has the text's name")
    rest = docs.drop(*added)
    place = rest.columns.index(text)
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])

    def run(table: pa.Table):
        e = _encoder(shared)
        offsets, ids, bounds, texts = [0], [], [], []
        for value in table.column(place).to_pylist():
            found, where = e.encode(value or "")
            size = len((value or "").encode("utf-8", "surrogatepass")) if end else 0
            found = np.concatenate([[e.m.begin] * begin, found, [e.m.end] * end]).astype(np.int32)
            ids.append(found)
            offsets.append(offsets[-1] + len(found))
            if spans:
                bounds.append(np.concatenate([np.zeros((int(begin), 2), np.int32), where, np.full((int(end), 2), size, np.int32)]))
            if decoded:
                texts.append(_text_of(e.m, found.tolist()))
        at = pa.array(offsets, pa.int32())
        out = table.append_column(into, pa.ListArray.from_arrays(at, pa.array(np.concatenate(ids))))
        if spans:
            pairs = np.concatenate(bounds).astype(np.int32)
            out = out.append_column(spans, pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["start", "end"])))
        if decoded:
            out = out.append_column(decoded, pa.array(texts, pa.string()))
        yield from out.combine_chunks().to_batches()

    kinds = ((into, ArrayType(IntegerType())), (spans, ArrayType(span)), (decoded, StringType()))
    fields = [StructField(name, kind) for name, kind in kinds if name]
    return map_texts(rest, run, StructType([*rest.schema.fields, *fields]), 200)


def decode(coded: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Replace ids by text; null ids are none."""
    shared = _share(coded.sparkSession, model_path)
    rest = coded.drop(into) if into != ids else coded

    def run(table: pa.Table):
        model = _encoder(shared).m
        texts = [_text_of(model, x or []) for x in table.column(ids).to_pylist()]
        yield from table.drop_columns([ids]).append_column(into, pa.array(texts, pa.string())).combine_chunks().to_batches()

    return map_texts(rest, run, rest.drop(ids).schema.add(into, "string"), 200)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public model files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece count and digests of ids and decoded text of every document, and the bytes that its pieces' spans cover."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, model_path(), spans="spans", end=True, decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), covered.alias("n_covered_bytes"))
