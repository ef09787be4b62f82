"""SentencePiece encoding that keeps source offsets, and decoding, for BPE models.

A text is encoded in three steps:

1. The normaliser walks the model's compiled character map: at every character the longest key of the
   map that starts there is replaced, and each character of the result records the source position
   that its key started at. White space is trimmed, prefixed and escaped as the model says.
2. The normalised text is merged into pieces by the library, behind a normaliser that does nothing;
   characters outside the vocabulary become byte pieces, or the unknown piece.
3. Every piece's ends in the normalised text, found from the lengths of the pieces before it, go through
   the recorded alignment to a span of bytes of the source.

Edge cases: a null text is read as empty, and an empty text has no pieces and decodes to nothing; a
text is read whole, whatever its length (a task holds the ids and spans of one batch of rows); rows
that share a doc_id are encoded one by one; an empty table gives an empty result; extra columns are
ignored. Models other than BPE, or with white space as a suffix, are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_rows

SPACE = "▁"
#: Types of pieces, as the model's file numbers them.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


def one_each(error: UnicodeDecodeError) -> tuple[str, int]:
    """A byte that can't be decoded is one replacement character, and reading goes on with the next byte."""
    return "�", error.start + 1


codecs.register_error("palimpsest_one_each", one_each)


def compiled_keys(blob: bytes) -> dict[str, str]:
    """Key -> replacement of a compiled character map: the size of its double array, the array, and the
    replacements, each ended by a zero byte. The array is walked a level of bytes at a time."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
    values = blob[4 + size :]
    jump = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    keys: dict[str, str] = {}
    labels = np.arange(1, 256)
    nodes, prefixes = np.array([jump(units[0])]), [b""]
    while len(nodes):
        next_nodes, next_prefixes = [], []
        for at in range(0, len(nodes), 4096):
            children = nodes[at : at + 4096, None] ^ labels
            inside = children < len(units)
            found = inside & ((units[np.where(inside, children, 0)] & 0x800000FF) == labels)
            for row, column in zip(*np.nonzero(found), strict=True):
                child = children[row, column]
                key, node = prefixes[at + row] + bytes([column + 1]), child ^ jump(units[child])
                if units[child] >> 8 & 1:
                    start = int(units[node] & 0x7FFFFFFF)
                    keys[key.decode()] = values[start : values.index(b"\0", start)].decode()
                next_nodes.append(node)
                next_prefixes.append(key)
        nodes, prefixes = np.array(next_nodes, np.int64), next_prefixes
    return keys


class Normaliser:
    """A model's normaliser over its compiled character map, with the source position of every character."""

    def __init__(self, spec, fixed: list[str]):
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.keys = compiled_keys(spec.precompiled_charsmap)
        self.fixed = re.compile("|".join(map(re.escape, sorted(fixed, key=len, reverse=True)))) if fixed else None
        self.longest = max(map(len, self.keys), default=0)
        firsts = {k[0] for k in self.keys if len(k) > 1}
        seconds = {k[1] for k in self.keys if len(k) > 1}
        some = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
        forms = [self.fixed.pattern] if fixed else []
        forms += [some({k for k in self.keys if len(k) == 1})] if any(len(k) == 1 for k in self.keys) else []
        forms += [f"{some(firsts)}(?={some(seconds)})"] if firsts else []
        #: Where a key may start: everywhere else the text passes unchanged.
        self.starts = re.compile("|".join(forms)) if forms else None

    def replaced(self, text: str, at: int) -> tuple[str, int] | None:
        """Replacement and length of the longest key that starts at a position; pieces that a user defined
        come before the map and stay as they are."""
        whole = self.fixed.match(text, at) if self.fixed else None
        if whole:
            return whole[0], len(whole[0])
        for length in range(min(self.longest, len(text) - at), 0, -1):
            value = self.keys.get(text[at : at + length])
            if value is not None:
                return value, length
        return None

    def mapped(self, text: str) -> tuple[str, np.ndarray, int]:
        """The text with every longest key replaced, the source position of each of its characters and of the
        end, and where the first key stands that is replaced by nothing."""
        out, origin, done, hole = [], [], 0, len(text)
        at = 0
        while self.starts and (m := self.starts.search(text, at)):
            found = self.replaced(text, m.start())
            if found is None:
                at = m.start() + 1
                continue
            value, length = found
            out += [text[done : m.start()], value]
            origin += [np.arange(done, m.start()), np.full(len(value), m.start())]
            if not value:
                hole = min(hole, m.start())
            at = done = m.start() + length
        if not out:
            return text, np.arange(len(text) + 1), hole
        return "".join([*out, text[done:]]), np.concatenate([*origin, np.arange(done, len(text) + 1)]), hole

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters, and its end, the source character it comes from."""
        if not text:
            return "", np.zeros(1, np.int64)
        out, origin, hole = self.mapped(text)
        begin = 0
        if self.trim:
            lead = len(out) - len(out.lstrip(" "))
            skipped = min(lead, int(np.searchsorted(origin[:lead], hole)))
            begin = int(min(origin[skipped], hole))
            if begin == len(text):
                return "", np.zeros(1, np.int64)
            codes = np.frombuffer(out.encode("utf-32-le", "surrogatepass"), "<u4")
            blank = codes == 0x20
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            out = codes[keep].tobytes().decode("utf-32-le", "surrogatepass")
            origin = np.concatenate([origin[:-1][keep], origin[-1:]])
        if self.prefix:
            out, origin = " " + out, np.concatenate([[begin], origin])
        if self.escape:
            out = out.replace(" ", SPACE)
        if self.trim:
            out = out.rstrip(SPACE if self.escape else " ")
            origin = origin[: len(out) + 1]
        return out, origin


class PieceModel:
    """A BPE model's pieces, read from its file (or given as its bytes)."""

    def __init__(self, path: str, proto: bytes | None = None):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto if proto is not None else open(path, "rb").read())
        spec, normal = model.trainer_spec, model.normalizer_spec
        if spec.model_type != spec.BPE or spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with white space as a prefix are read")
        self.types = np.array([p.type for p in model.pieces])
        self.lengths = np.array([len(p.piece) for p in model.pieces])
        self.value = np.full(len(self.types), -1)  # of byte pieces
        self.value[self.types == BYTE] = [int(p.piece[1:-1], 16) for p in model.pieces if p.type == BYTE]
        self.byte_fallback = spec.byte_fallback
        self.normaliser = Normaliser(normal, [p.piece for p in model.pieces if p.type == USER_DEFINED])
        self.strips, self.strips_all = normal.add_dummy_prefix or normal.remove_extra_whitespaces, normal.remove_extra_whitespaces
        self.names = [str(i) for i in range(len(self.types))]
        self.silent = set(np.nonzero(self.types == CONTROL)[0].tolist())
        surface = {BYTE: lambda p: bytes([int(p[1:-1], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: spec.unk_surface.encode()}
        self.surface = [surface.get(p.type, lambda p: p.replace(SPACE, " ").encode())(p.piece) for p in model.pieces]
        # the merges run on text that is normal already: the same pieces behind a normaliser that does nothing
        normal.Clear()
        normal.name, normal.add_dummy_prefix, normal.remove_extra_whitespaces, normal.escape_whitespaces = "identity", False, False, False
        self.merges = SentencePieceProcessor(model_proto=model.SerializeToString())

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a whole text, and the begin and end of each in the text's UTF-8 bytes. Of the byte pieces of one
        character the last has its span, those before it an empty one."""
        text = text or ""
        normal, origin = self.normaliser.normalise(text)
        ids = self.merges.encode(normal, return_type="numpy").astype(np.int64)
        if self.byte_fallback:
            value = self.value[ids]
            more = np.concatenate([(value[1:] & 0xC0) == 0x80, [False]]) & (np.concatenate([value[1:], [-1]]) >= 0)
            lengths = np.where(value < 0, self.lengths[ids], ~more)
        else:  # unknown characters side by side are one piece
            lengths = np.array([len(p) for p in self.merges.encode(normal, return_type=str)], np.int64)
        ends = np.cumsum(lengths, dtype=np.int64)
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            origin = np.concatenate([[0], np.cumsum(sizes)])[origin]
        return ids, origin[ends - lengths], origin[ends]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces are silent, bytes that stand together are read as UTF-8, the white space
        that the normaliser put in front goes."""
        head: list[bytes] = []
        at = 0
        while self.strips and at < len(ids) and self.types[ids[at]] != BYTE:
            value, at = self.surface[ids[at]], at + 1
            stripped = self.types[ids[at - 1]] in (NORMAL, USER_DEFINED) and value.startswith(b" ")
            value = value[1:] if stripped else value
            head.append(value)
            if value or (stripped and not self.strips_all):
                break
        rest = ids[at:]
        breaks = [k for k, i in enumerate(rest) if i in self.silent] if self.silent.intersection(rest) else []
        parts = [rest[a:b] for a, b in zip([0, *breaks], [*breaks, len(rest)], strict=True)]  # control pieces part the bytes around them
        read = lambda values: b"".join(values).decode("utf-8", "palimpsest_one_each")
        return read([*head, *map(self.surface.__getitem__, parts[0])]) + "".join(read(map(self.surface.__getitem__, p)) for p in parts[1:])


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids and spans (begin and end of each piece in the text's UTF-8 bytes) of every row."""
    path = model or public_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = PieceModel(path)
        for b in batches:
            found = [pieces.encode(text) for text in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], **{c: [f[i] for f in found] for i, c in enumerate(("ids", "begins", "ends"))}})

    found = map_rows(docs, ["doc_id"], [F.col("text").cast("string")], run, "ids array<int>, begins array<long>, ends array<long>")
    return found.select("doc_id", "ids", F.arrays_zip(F.col("begins").alias("begin"), F.col("ends").alias("end")).alias("spans"))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and the text of every row's ids; null ids are read as none."""
    path = model or public_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = PieceModel(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [pieces.decode([] if ids is None else list(ids)) for ids in b["ids"]]})

    return map_rows(encoded, ["doc_id"], ["ids"], run, "text string")


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """encode and decode of every row in one pass, as doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_crc32
    (of the begins, then the ends, as little-endian 64-bit numbers): ids and texts stay in the task that made them."""
    path = model or public_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = PieceModel(path)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for b in batches:
            rows = []
            for text in b["text"]:
                ids, begins, ends = pieces.encode(text)
                listed = ids.tolist()
                spans = zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(begins.astype("<i8").tobytes()))
                rows.append((len(listed), sha(",".join(map(pieces.names.__getitem__, listed))), sha(pieces.decode(listed)), spans))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    return map_rows(docs, ["doc_id"], [F.col("text").cast("string")], run, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
