"""SentencePiece models as weighted finite-state transducers: encode by shortest path, decode by lookup."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

from panelift.llm.catalog import query, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Fixed values of the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

#: Entries kept of each memory of a worker before it is emptied.
MEMORY = 400_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield number, data[at : at + size]
            at += size


class Transducer:
    """Normaliser, pieces and byte fallback of one model.

    The composed machine reads a normalised text and emits pieces; a state is (position, last piece).
    Weights live in the tropical semiring. Unigram models: a piece weighs minus its score. Merge
    (BPE) models: a piece weighs 0 after a piece that the merge order lets stand before it, and
    infinity otherwise; exactly one path is finite, the model's own segmentation. Characters outside
    the pieces go through the byte arcs.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, prefix: bool = True, trim: bool = False):
        self.pieces, self.kind, self.prefix, self.trim = pieces, kind, prefix, trim
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER_DEFINED)}
        self.scores = {p: pieces[i][1] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.floor = min(self.scores.values(), default=0.0) - 10
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # pieces never run on into a space or over a line end, so texts fall into short parts
        lone = "" if crossing or any("\n" in p for p in self.ids) else "\n"
        self.part = re.compile(rf"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+|\n" if not crossing else r"(?s).+")
        self.outputs = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, _, t in pieces
        ]
        self.known: dict[str, list[int]] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.spines: dict[tuple[str, bool], list | None] = {}
        self.remembered = 0
        self.trie: dict = {}
        for p, score in self.scores.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p, -score

    @classmethod
    def read(cls, model: bytes) -> Transducer:
        pieces, kind, prefix, trim = [], UNIGRAM, True, True
        for number, value in _fields(model):
            if number == 1:
                x = dict(_fields(value))
                pieces.append((x[1].decode(), float(np.frombuffer(x.get(2, b"\0" * 4), "<f4")[0]), x.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                x = dict(_fields(value))
                if x.get(2):
                    raise ValueError("models with a character map are not supported")
                prefix, trim = bool(x.get(3, 1)), bool(x.get(4, 1))
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models are supported")
        return cls(pieces, kind, prefix, trim)

    def normalise(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def merged(self, part: str) -> list[str]:
        """The pieces that merging in score order leaves (leftmost first among equals)."""
        if len(part) > 64:
            return self._merged_long(part)
        out = list(part)
        while True:
            best = max(((self.scores.get(a + b, -math.inf), -i) for i, (a, b) in enumerate(zip(out, out[1:]))), default=(-math.inf, 0))
            if best[0] == -math.inf:
                return out
            i = -best[1]
            out[i : i + 2] = [out[i] + out[i + 1]]

    def _merged_long(self, part: str) -> list[str]:
        """``merged`` with a heap of neighbours, for parts of any length."""
        parts: list[str | None] = list(part)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        waiting = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                both = parts[i] + parts[j]
                if both in self.scores:
                    heapq.heappush(waiting, (-self.scores[both], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while waiting:
            _, i, both = heapq.heappop(waiting)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _spine(self, piece: str, right: bool) -> list[tuple[str, float]] | None:
        """(part, rank of the merge that swallows it) at one edge of a piece, from its character up.

        None for a piece that merging does not produce.
        """
        key = (piece, right)
        if key not in self.spines:
            out, children = list(piece), {}
            while len(out) > 1:
                score, i = max((self.scores.get(a + b, -math.inf), -i) for i, (a, b) in enumerate(zip(out, out[1:])))
                if score == -math.inf:
                    break
                children[out[-i] + out[1 - i]] = out[-i], out[1 - i]
                out[-i : 2 - i] = [out[-i] + out[1 - i]]
            spine = [(piece, math.inf)] if len(out) == 1 else None
            while spine and len(spine[0][0]) > 1:
                spine.insert(0, (children[spine[0][0]][right], -self.scores[spine[0][0]]))
            self.spines[key] = spine
        return self.spines[key]

    def _follows(self, left: str, right: str) -> bool:
        """Whether merging leaves ``left`` + ``right`` apart.

        Walks up the parts that touch at the border, in merge order: if the two of them would merge
        before either is swallowed by its own piece, the pair does not stand. Equal ranks go left first.
        """
        a, b = self._spine(left, True), self._spine(right, False)
        if a is None or b is None:
            return False
        i = j = 0
        while True:
            (x, after_x), (y, after_y) = a[i], b[j]
            merge = -self.scores.get(x + y, -math.inf)
            if merge < math.inf and merge < after_x and merge <= after_y:
                return False
            if after_x == after_y == math.inf:
                return True
            if after_x <= after_y:
                i += 1
            else:
                j += 1

    def _arcs(self, part: str, start: int) -> list[tuple[str, float]]:
        """(piece, weight) that may begin at ``start``, shortest first; a character that is no piece is a byte arc."""
        found = []
        node = self.trie
        for end in range(start, len(part)):
            node = node.get(part[end])
            if node is None:
                break
            if "" in node:
                found.append(node[""])
        if not found or len(found[0][0]) > 1:
            found.insert(0, (part[start], -self.floor))
        return found

    def shortest_path(self, part: str) -> list[str]:
        """The pieces on the path of least weight."""
        return self._finite_path(part) if self.kind == BPE else self._cheapest_path(part)

    def _cheapest_path(self, part: str) -> list[str]:
        """Viterbi over positions."""
        n = len(part)
        cost, back = [0.0] + [math.inf] * n, [""] * (n + 1)
        for start in range(n):
            for arc, weight in self._arcs(part, start):
                end = start + len(arc)
                if cost[start] + weight < cost[end]:
                    cost[end], back[end] = cost[start] + weight, arc
        out = []
        while n:
            out.append(back[n])
            n -= len(back[n])
        return out[::-1]

    def _finite_path(self, part: str) -> list[str]:
        """Depth first, longest arc first: weights are 0 or infinite, and the first complete path is the only one.

        A prefix has one finite path at most, so a position that led nowhere is never tried again.
        """
        n, pairs, dead = len(part), self.pairs, set()
        out: list[str] = []
        stack = [(0, self._arcs(part, 0))]
        while stack:
            at, arcs = stack[-1]
            last = out[-1] if out else ""
            fits = pairs.get(last)
            if fits is None:
                fits = pairs[last] = {}
            while arcs:
                arc = arcs.pop()[0]
                end = at + len(arc)
                if end in dead:
                    continue
                fit = fits.get(arc)
                if fit is None:
                    fit = fits[arc] = self._follows(last, arc) if last else self._spine(arc, True) is not None
                    self.remembered += 1
                if fit:
                    out.append(arc)
                    if end == n:
                        if self.remembered > MEMORY:
                            pairs.clear()
                            self.remembered = 0
                        return out
                    stack.append((end, self._arcs(part, end)))
                    break
            else:
                dead.add(at)
                stack.pop()
                if out:
                    out.pop()
        return self.merged(part)  # only for models whose pieces do not come from merges

    def _emit(self, part: str) -> list[int]:
        # runs of spaces are merged by equal scores, where neighbours alone do not fix the path
        path = self.merged(part) if self.kind == BPE and SPACE * 2 in part else self.shortest_path(part)
        out = []
        for p in path:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for part in self.part.findall(self.normalise(text)):
            ids = known.get(part)
            if ids is None:
                if len(known) >= MEMORY:
                    known.clear()
                ids = self._emit(part)
                if len(part) <= 64:
                    known[part] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        """The text of ``ids``; without the space that the normaliser put first. Broken byte runs become U+FFFD."""
        data = b"".join([self.outputs[i] for i in ids])
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    """One machine per worker and model, so that its memory serves all batches."""
    return Transducer.read(model)


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, ids: str = "ids", round_trip: str | None = None) -> DataFrame:
    """``docs`` with the piece ids of each whole text, and optionally whether decoding gives the text back.

    Null and empty texts have no ids and come back as empty. A text that holds U+2581 itself comes back with
    spaces there, so it is no round trip. The model file is read on the driver and sent along; columns of
    the output's names are replaced.
    """
    with open(model, "rb") as f:
        content = f.read()
    docs = docs.drop(ids, *([round_trip] if round_trip else []))
    schema = StructType(list(docs.schema.fields)).add(ids, ArrayType(IntegerType()))
    if round_trip:
        schema = schema.add(round_trip, BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(content)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                flat, ends, same = [], [0], []
                for value in rows.column(text).to_pylist():
                    found = machine.encode(value or "")
                    flat.append(np.array(found, np.int32))
                    ends.append(ends[-1] + len(found))
                    if round_trip:
                        same.append(machine.decode(found) == (value or ""))
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                rows = rows.append_column(ids, column)
                yield rows.append_column(round_trip, pa.array(same, pa.bool_())) if round_trip else rows

    return docs.mapInArrow(run, schema)


@query("op6_sentencepiece")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every document."""
    coded = encode(table(spark, folder, "documents").select("doc_id", "text"), round_trip="round_trip")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
