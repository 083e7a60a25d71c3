"""Piece encoding that keeps every piece's place in the original bytes, and decoding.

A text is normalised by the model's compiled character map: at each byte the longest prefix
in the map's trie is exchanged, and each normalised byte remembers the source bytes it came
from. The normalised text is cut where white space begins, since no piece of the vocabulary
runs from a letter into white space; equal cuts are encoded once. Piece lengths in normalised
bytes, summed up, give places that the alignment projects to spans of source bytes.

Defined results: a null text is an empty one, which has no piece but the end id; spans of
pieces added by the model (end id, leading space) are empty where nothing in the source made
them; rows may repeat; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.llm.textbytes import text_chunks

MARK = "▁"
CACHE = 100_000  # cuts held by a task; beyond it the cache starts afresh
DDL = "doc_id bigint, ids array<int>, starts array<int>, stops array<int>, decoded string"


class CharacterMap:
    """A compiled map: a double-array trie over UTF-8 keys whose values point at replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], dtype="<u4").tolist()
        self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that begins at a byte."""
        units, best = self.units, None
        if not units:
            return None

        def child_base(unit: int) -> int:
            return (unit >> 10) << ((unit & 0x200) >> 6)

        node = child_base(units[0])
        for length, byte in enumerate(data[at:], 1):
            node ^= byte
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != byte:
                break
            node ^= child_base(unit)
            if unit & 0x100:
                best = (units[node] & 0x7FFFFFFF, length)
        if best is None:
            return None
        start = best[0]
        return self.strings[start:self.strings.index(b"\0", start)], best[1]


def _character_length(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normaliser:
    """The normalisation rules of a model."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, strip_spaces: bool = False):
        self.map = CharacterMap(charsmap)
        self.dummy_prefix, self.strip_spaces = dummy_prefix, strip_spaces

    def __call__(self, data: bytes) -> tuple[str, np.ndarray]:
        """Normalised text, and the source byte of each normalised byte and of the end."""
        if not self.map.units and not self.strip_spaces:
            return self._plain(data)
        parts: list[tuple[bytes, int, int]] = []
        at, spaced = 0, self.strip_spaces  # leading spaces count as following a space
        while at < len(data):
            found = self.map.longest(data, at)
            new, length = found if found else (data[at:at + _character_length(data[at])], _character_length(data[at]))
            kept = new.lstrip(b" ") if spaced else new
            if kept:
                if self.strip_spaces:
                    kept = re.sub(rb" {2,}", b" ", kept) if found else kept
                parts.append((kept, at, at + length))
            if self.strip_spaces:
                spaced = kept.endswith(b" ") if kept else spaced
            at += length
        stop = len(data)
        while self.strip_spaces and parts and parts[-1][0].endswith(b" "):
            rest = parts[-1][0].rstrip(b" ")
            stop = parts[-1][1]
            parts[-1:] = [(rest, *parts[-1][1:])] if rest else []
        out, sources = [], []
        if self.dummy_prefix and parts:
            out.append(MARK)
            sources += [parts[0][1]] * 3
        for new, source, _ in parts:
            text = new.decode("utf-8", "replace").replace(" ", MARK)
            out.append(text)
            size = len(text.encode())
            same = size == len(new) and new == data[source:source + size]
            sources += range(source, source + size) if same else [source] * size
        return "".join(out), np.array([*sources, stop], dtype=np.int64)

    def _plain(self, data: bytes) -> tuple[str, np.ndarray]:
        """No map: only spaces change, from one byte to three."""
        if not data:
            return "", np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)
        width = np.where(raw == 0x20, 3, 1)
        if self.dummy_prefix:
            width[0] += 3
        text = data.decode("utf-8", "replace").replace(" ", MARK)
        return (MARK if self.dummy_prefix else "") + text, np.append(np.repeat(np.arange(len(raw)), width), len(raw))


class PieceModel:
    """A piece vocabulary with its normaliser; encodes with an end id, without sampling."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        self.normaliser = Normaliser(rules.precompiled_charsmap, rules.add_dummy_prefix, rules.remove_extra_whitespaces)
        kinds = model.SentencePiece
        self.end_id = next((i for i, p in enumerate(model.pieces) if p.piece == (model.trainer_spec.eos_piece or "</s>")), -1)
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), -1)
        self.bytes_of = [
            b"" if p.type == kinds.CONTROL
            else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE
            else (model.trainer_spec.unk_surface or " ⁇ ").encode() if p.type == kinds.UNKNOWN
            else p.piece.encode() for p in model.pieces]
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        whole = any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)
        self.cut = re.compile(r"(?s).+") if whole else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        rules.precompiled_charsmap = b""  # cuts are normalised already
        rules.name, rules.add_dummy_prefix, rules.remove_extra_whitespaces = "identity", False, False
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.cache: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}  # piece lengths of cuts that hold an unknown piece

    def learn(self, cuts: Sequence[Sequence[str]]) -> None:
        """Encode the cuts that were not met yet."""
        if len(self.cache) > CACHE:
            self.cache.clear()
            self.odd.clear()
        new = list({c for own in cuts for c in own if c not in self.cache})
        for text, ids in zip(new, self.pieces.encode(new, num_threads=1) if new else []):
            self.cache[text] = np.array(ids, dtype=np.int32).tobytes()
            if self.unknown in ids:
                surfaces = self.pieces.encode(text, out_type="immutable_proto").pieces
                self.odd[text] = np.array([len(p.surface.encode()) for p in surfaces], dtype=np.int32).tobytes()

    def lay_out(self, cuts: Sequence[str], ids: np.ndarray) -> np.ndarray:
        """Length of each piece in normalised bytes."""
        if not self.odd or self.unknown not in ids:
            return self.lengths[ids]
        return np.concatenate([np.frombuffer(self.odd[c], dtype=np.int32) if c in self.odd
                               else self.lengths[np.frombuffer(self.cache[c], dtype=np.int32)] for c in cuts])

    def encode(self, texts: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, starts and stops of each text; spans are source bytes, stops exclusive."""
        normal = [self.normaliser(t) for t in texts]
        cuts = [self.cut.findall(t) for t, _ in normal]
        self.learn(cuts)
        for own, (_, source) in zip(cuts, normal):
            ids = np.frombuffer(b"".join(map(self.cache.__getitem__, own)), dtype=np.int32)
            stops = source[np.cumsum(self.lay_out(own, ids))]
            starts = np.concatenate(([source[0]] if len(ids) else [], stops[:-1]))
            end = source[-1]
            yield np.append(ids, np.int32(self.end_id)), np.append(starts, end).astype(np.int32), np.append(stops, end).astype(np.int32)

    def decode(self, ids: Sequence[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        if (self.normaliser.dummy_prefix or self.normaliser.strip_spaces) and text.startswith(" "):
            return text[1:]
        return text


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids with the end id, starts and stops in source bytes, and the ids decoded.
    ``model_path`` must name the model file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch):
                texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                ids, starts, stops = zip(*model.encode(texts))
                lists = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                columns = [pa.ListArray.from_arrays(lists, pa.array(np.concatenate(c).astype(np.int32))) for c in (ids, starts, stops)]
                decoded = pa.array([model.decode(x.tolist()) for x in ids], type=pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *columns, decoded],
                                                 names=["doc_id", "ids", "starts", "stops", "decoded"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, DDL)
