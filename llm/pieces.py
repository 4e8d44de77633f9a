"""SentencePiece encoding and decoding that keeps offsets.

A text is normalised by longest prefixes: at each place where an entry of the
model's compiled character map (a double-array trie) can begin, the longest one
is replaced; what no entry can touch is copied in one go. Every normalised byte
records the byte of the original text that it comes from. The normalised text
falls apart where no piece of the vocabulary can reach across (before a word
mark); each part is merged pair by pair, best piece first, and remembered; and
every piece is projected to its byte span in the original.

Defined cases: a null text counts as empty and gives the end id alone; texts of
any length are encoded whole (merging takes n log n); characters outside the
vocabulary become byte pieces (the span of the character goes to its last byte)
or the unknown piece where the model has no byte pieces (neighbouring unknown
characters are one).
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MEMO_PARTS, MEMO_CHARS, ROWS = 500_000, 64, 256
SCAN_CHARS, NEVER = 48, float("inf")


class CharMap:
    """The compiled character map: a double-array trie of UTF-8 prefixes and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size:]
        first = bytes(c for c in range(256) if self.units and self._begins(c))
        # runs of bytes at which no entry begins
        self.free = re.compile(b"[^" + re.escape(first) + b"]+" if first else b"(?s).+").match

    def _begins(self, c: int) -> bool:
        node = self.units[0] >> 10 << ((self.units[0] & 512) >> 6)
        return self.units[node ^ c] & 0x800000FF == c

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes consumed at ``at`` and their replacement, by the longest entry; None without one."""
        units, found = self.units, None
        if not units:
            return None
        node = units[0] >> 10 << ((units[0] & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if not found:
            return None
        return found[0], self.texts[found[1]:self.texts.index(b"\0", found[1])]


class Pieces:
    """One model: normaliser, merges, parts that are remembered, spans and decoding."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.chars, self.prefix, self.squeeze = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces
        if not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that keep white space as it is or mark word ends are not covered")
        kinds = model.SentencePiece
        if model.trainer_spec.model_type != model.trainer_spec.BPE or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models other than plain pair merging are not covered")
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type == kinds.CONTROL else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.is_byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.end = next((i for i, p in enumerate(model.pieces) if p.piece == model.trainer_spec.eos_piece), -1)
        self.bytes_of[self.unknown] = model.trainer_spec.unk_surface.encode()
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.known = {p.piece: (i, len(p.piece.encode())) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte_ids = {self.bytes_of[i][0]: i for i in np.flatnonzero(self.is_byte).tolist()}
        # no piece has a mark after another character: words are segmented apart
        apart = not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if apart else r"(?s).+").findall
        self.memo: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its UTF-8 bytes and its end, the byte of the original it comes from."""
        data, at, out, source = text.encode(), 0, [], []
        while at < len(data):
            if run := self.chars.free(data, at):
                out.append(run[0])
                source.append(np.arange(at, run.end(), dtype=np.int32))
                at = run.end()
                continue
            hit = self.chars.longest(data, at)
            n = hit[0] if hit else 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
            out.append(hit[1] if hit else data[at:at + n])
            source.append(np.full(len(out[-1]), at, np.int32))
            at += n
        norm, where = b"".join(out), np.concatenate([*source, np.array([len(data)], np.int32)])
        if self.squeeze:
            norm, where = self._squeezed(norm, where)
        if not norm:
            return "", where[-1:]
        # a space becomes the mark's three bytes, all from the space's place
        times = np.where(np.frombuffer(norm + b"x", np.uint8) == 32, 3, 1)
        norm, where = norm.replace(b" ", MARK.encode()), np.repeat(where, times)
        if self.prefix:
            norm, where = MARK.encode() + norm, np.concatenate([where[:1].repeat(3), where])
        return norm.decode(), where

    def _squeezed(self, norm: bytes, where: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Without leading, trailing and repeated spaces."""
        space = np.frombuffer(norm, np.uint8) == 32
        inner = ~(space & np.concatenate([[True], space[:-1]]))
        kept = np.flatnonzero(inner)
        end = where[-1]
        if len(kept) and space[kept[-1]]:
            end, kept = where[kept[-1]], kept[:-1]
        elif not len(kept):
            end = where[0]
        return bytes(np.frombuffer(norm, np.uint8)[kept]), np.concatenate([where[kept], [end]]).astype(np.int32)

    def merged(self, part: str) -> list[str]:
        """The pieces of a normalised part: of all neighbours the pair that makes the best piece is joined, the first of equal ones, again and again."""
        text, cost = list(part), self.cost.get
        if len(text) > SCAN_CHARS:
            return self._merged_by_heap(text)
        costs = [cost(x + y, NEVER) for x, y in zip(text, text[1:], strict=False)]
        while costs:
            best = min(costs)
            if best == NEVER:
                break
            i = costs.index(best)
            text[i] += text.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = cost(text[i] + text[i + 1], NEVER)
            if i:
                costs[i - 1] = cost(text[i - 1] + text[i], NEVER)
        return text

    def _merged_by_heap(self, text: list[str]) -> list[str]:
        """The same for long parts, in n log n."""
        cost, n = self.cost.get, len(text)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(c, i, both) for i, both in enumerate(map(str.__add__, text, text[1:])) if (c := cost(both)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if j >= n or not text[i] or text[i] + text[j] != both:
                continue  # one of the two has been joined with another since
            text[i], text[j] = both, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (c := cost(both + text[k])) is not None:
                    heapq.heappush(heap, (c, i, both + text[k]))
            h = left[i]
            if h >= 0 and (c := cost(text[h] + both)) is not None:
                heapq.heappush(heap, (c, h, text[h] + both))
        return [t for t in text if t]

    def _entry(self, part: str) -> bytes:
        """The id of each of a part's pieces and the normalised bytes that it covers, in turn."""
        pieces = self.merged(part)
        try:
            return array("i", [x for p in pieces for x in self.known[p]]).tobytes()
        except KeyError:
            out: list[list[int]] = []
        for piece in pieces:
            data = piece.encode()
            if piece in self.known:
                out.append([*self.known[piece]])
            elif self.byte_ids:  # a character's span goes to the last of its bytes
                out += [[self.byte_ids[c], 0] for c in data]
                out[-1][1] = len(data)
            elif out and out[-1][0] == self.unknown:
                out[-1][1] += len(data)
            else:
                out.append([self.unknown, len(data)])
        return array("i", [x for p in out for x in p]).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids without the end id, piece ends in bytes of the original; a piece begins where the last one ends)."""
        norm, source = self.normalise(text)
        parts, memo = self.parts(norm), self.memo
        try:
            got = [memo[p] for p in parts]
        except KeyError:
            new = {p: self._entry(p) for p in dict.fromkeys(parts) if p not in memo}
            got = [memo.get(p) or new[p] for p in parts]
            if len(memo) + len(new) > MEMO_PARTS:
                memo.clear()
            memo.update((p, e) for p, e in new.items() if len(p) <= MEMO_CHARS)
        flat = np.frombuffer(b"".join(got), np.int32).reshape(-1, 2)
        return flat[:, 0], source[np.cumsum(flat[:, 1], dtype=np.int64)]

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join([self.bytes_of[i] for i in ids.tolist()])
        if (self.prefix or self.squeeze) and data[:1] == b" ":
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_runs(ids)

    def _decode_runs(self, ids: np.ndarray) -> str:
        """Runs of byte pieces that are no UTF-8 give one replacement character for each bad byte."""
        out = []
        run = b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.bytes_of[i]
                continue
            while run:
                n = next((n for n in (1, 2, 3, 4) if _valid(run[:n])), 0)
                out.append(run[:n].decode() if n else "�")
                run = run[max(n, 1):]
            if i >= 0:
                out.append(self.bytes_of[i].decode())
        text = "".join(out)
        return text[1:] if (self.prefix or self.squeeze) and text[:1] == " " and not self.is_byte[ids[0]] else text


def _valid(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_and_decode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, ids, begins, ends, decoded) for each row of ``docs(doc_id, text)``.

    ids close with the end id; begins and ends are byte spans in the UTF-8 of the
    original text, one for each id but the last; decoded is the text of the ids.
    One narrow pass: each task reads the model from its machine's tokenizer
    folder, remembers at most MEMO_PARTS word parts and returns small batches.
    """

    def run(batches):
        p = pieces(model_path or default_model())
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                texts = [t or "" for t in some["text"].to_pylist()]
                got = [p.encode(t) for t in texts]
                decoded = pa.array([p.decode(ids) for ids, _ in got], pa.string())
                end = np.array([p.end], np.int32)
                sizes = np.array([len(ids) for ids, _ in got])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int32))
                spans = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                ids = np.concatenate([x for g, _ in got for x in (g, end)])
                ends = np.concatenate([e for _, e in got])
                begins = np.concatenate([np.concatenate([[0], e[:-1]]) if len(e) else e for _, e in got]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    some["doc_id"], pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(spans, pa.array(begins, pa.int32())),
                    pa.ListArray.from_arrays(spans, pa.array(ends, pa.int32())), decoded],
                    ["doc_id", "ids", "begins", "ends", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")


def token_digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256) of what ``encode_and_decode`` returned.

    spans_sha256 is over the pieces' byte spans: all begins, then all ends, joined by one space."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.array_join(F.concat("begins", "ends").cast("array<string>"), " "), 256).alias("spans_sha256"))
