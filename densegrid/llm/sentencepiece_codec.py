"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton over the pieces reads a segment once. At every position the output links give all pieces that end
there, and each of them relaxes the best way to reach the position:

- ``unigram`` models: the way with the highest sum of piece scores.
- ``bpe`` models: a step from piece p to piece t is open only if byte-pair merging of their joint text gives just
  (p, t). Every prefix then has exactly one open way, and it is the one that merging the whole text gives.

Characters without a piece become their UTF-8 byte pieces (or the unknown piece). As in the models served here, a
blank is written U+2581, one is put in front, and U+2581 itself reads back as a blank; everything else is decoded
as it was. Null text counts as empty; an empty text has no pieces. A text of any length is encoded whole. Segments
are the parts no piece can cross: before a blank after another character, and around characters of no piece.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

BLANK = "▁"
NORMAL, BYTE, UNKNOWN, OTHER = range(4)
#: Entries of a task's segment cache, and the longest segment it takes. Neither changes a result.
CACHE, CACHED_CHARS = 300_000, 48
#: Texts that are encoded together: at most so many, or so many characters and one text more.
TEXTS, CHARS = 500, 2_000_000


def load_pieces(path: str) -> list[tuple[str, float, int]]:
    """``(piece, score, kind)`` in the order of ids, read from a model file on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def kind(i: int) -> int:
        if model.is_byte(i):
            return BYTE
        if model.is_unknown(i):
            return UNKNOWN
        return OTHER if model.is_control(i) or model.is_unused(i) else NORMAL

    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


def _segments(pieces: set[str]) -> re.Pattern:
    """Pattern of the parts of a text that no piece reaches across, read off the pieces.

    Borders are: before a blank after another character; around line breaks and tabs that are in no piece; between
    marks and other characters. Marks are the comma and all characters that pieces join to it, directly or in steps.
    """
    if any(BLANK in p.lstrip(BLANK) for p in pieces):
        return re.compile("(?s:.+)")
    joined: dict[str, set[str]] = {}
    for piece in pieces:
        for x, y in zip(piece, piece[1:]):
            if x != BLANK:
                joined.setdefault(x, set()).add(y)
                joined.setdefault(y, set()).add(x)
    marks, ahead = {","}, [","]
    while ahead:
        new = joined.get(ahead.pop(), set()) - marks
        marks |= new
        ahead += new
    if any(c.isalpha() for c in marks):
        marks = set()
    used = set(chain.from_iterable(pieces))
    breaks = re.escape("".join(c for c in "\n\t\r" if c not in used))
    mark = re.escape("".join(sorted(marks)))
    ways = [rf"{BLANK}*[^{BLANK}{breaks}{mark}]+", rf"{BLANK}*[{mark}]+" if marks else "", rf"{BLANK}+", rf"[{breaks}]" if breaks else ""]
    return re.compile("|".join(filter(None, ways)))


class _Segments(dict):
    """Ids by segment. When full, its entries become the older half; those used again move back."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        found = self.older.get(text)
        if found is None:
            found = tuple(self.codec.viterbi(text))
        if len(text) <= CACHED_CHARS:
            if len(self) >= CACHE // 2:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


class Codec:
    """Automaton and tables of one model; built once per Python worker."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: str):
        if kind not in ("bpe", "unigram"):
            raise ValueError(kind)
        self.bpe = kind == "bpe"
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.score = [s for _, s, _ in pieces]
        self.length = [len(p) for p, _, _ in pieces]
        self.piece = [p for p, _, _ in pieces]
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.unknown_score = min(self.score[i] for i in self.ids.values()) - 10
        self.segment = _segments(set(self.ids))
        self.open: dict[int, bool] = {}
        self.cache = _Segments(self)
        # The last segment, and per position its best last piece, score and automaton node.
        self.text, self.last, self.best, self.nodes = "", [-1], [0.0], [0]
        # The two parts that the last merge of a piece joins, and its rank; characters have none and rank first.
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = [-1.0] * len(pieces)
        kept = []
        for p, i in self.ids.items():
            trace = self.merge(p) if self.bpe else [(p, "", "")]
            if len(trace) != 1:
                continue
            kept.append((p, i))
            if len(p) > 1 and self.bpe:
                self.parts[i] = (self.ids.get(trace[0][1], -1), self.ids.get(trace[0][2], -1))
                self.rank[i] = -self.score[i]
        self._build(kept)

    def _build(self, pieces: list[tuple[str, int]]) -> None:
        """Trie, failure links (breadth first) and output links: the next shorter suffix that is a piece."""
        self.step: list[dict[str, int]] = [{}]
        own = [-1]
        for text, i in pieces:
            node = 0
            for c in text:
                if c not in self.step[node]:
                    self.step[node][c] = len(self.step)
                    self.step.append({})
                    own.append(-1)
                node = self.step[node][c]
            own[node] = i
        self.fail, link = [0] * len(self.step), [0] * len(self.step)
        # Pieces ending at a node, longest first: its own and, through the output link, those of its suffixes.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.step)
        queue = deque(self.step[0].values())
        while queue:
            node = queue.popleft()
            f = self.fail[node]
            link[node] = f if own[f] >= 0 else link[f]
            first = ((own[node], self.length[own[node]]),) if own[node] >= 0 else ()
            self.ends[node] = first + self.ends[link[node]]
            for c, child in self.step[node].items():
                g = f
                while g and c not in self.step[g]:
                    g = self.fail[g]
                self.fail[child] = self.step[g].get(c, 0)
                queue.append(child)

    def merge(self, text: str) -> list[tuple[str, str, str]]:
        """Byte-pair merging of a short text, best score first, ties from the left: parts and what each was joined of."""
        parts = [(c, "", "") for c in text]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i][0] + parts[i + 1][0])
                if j is not None and (best is None or self.score[j] > best):
                    best, at = self.score[j], i
            if best is None:
                return parts
            a, b = parts[at][0], parts[at + 1][0]
            parts[at: at + 2] = [(a + b, a, b)]

    def _open(self, p: int, t: int) -> bool:
        """Whether merging the joint text of two pieces leaves the border between them.

        Undoes the later of the merges next to the border, again and again; the border holds if no pair that faced
        each other there could have merged before one of the two was taken.
        """
        piece, ids, rank = self.piece, self.ids, self.rank
        if piece[p].startswith(BLANK + BLANK) or piece[t].startswith(BLANK + BLANK) or piece[p] == BLANK:
            return [x[0] for x in self.merge(piece[p] + piece[t])] == [piece[p], piece[t]]  # blanks have one score
        limit = float("inf")
        while True:
            joined = ids.get(piece[p] + piece[t])
            if joined is not None and -self.score[joined] < limit:
                return False
            if rank[p] > rank[t]:
                limit, p = rank[p], self.parts[p][1]
            elif rank[t] >= 0:
                limit, t = rank[t] + 0.5, self.parts[t][0]
            else:
                return True

    def viterbi(self, text: str) -> list[int]:
        """Ids of one segment. ``-1`` as last piece stands for a character without a piece."""
        n = len(text)
        step, fail, ends, score, opened = self.step, self.fail, self.ends, self.score, self.open
        bpe, size = self.bpe, len(self.piece)
        # A position depends on what is before it only: go on where the segment before differs from this one.
        end = 0
        for c, before in zip(text, self.text):
            if c != before:
                break
            end += 1
        last, best, nodes = self.last, self.best, self.nodes
        del last[end + 1:], best[end + 1:], nodes[end + 1:]
        last += [-2] * (n - end)
        best += [0.0] * (n - end)
        self.text, node = text, nodes[end]
        for c in text[end:]:
            end += 1
            while node and c not in step[node]:
                node = fail[node]
            node = step[node].get(c, 0)
            nodes.append(node)
            long = 0
            for t, long in ends[node]:
                start = end - long
                p = last[start]
                if p == -2:
                    continue
                if bpe:
                    if p == -1:
                        last[end] = t
                        break
                    fits = opened.get(p * size + t)
                    if fits is None:
                        if len(opened) > CACHE:
                            opened.clear()
                        fits = opened[p * size + t] = self._open(p, t)
                    if fits:
                        last[end] = t
                        break
                elif last[end] == -2 or best[start] + score[t] > best[end]:
                    best[end], last[end] = best[start] + score[t], t
            if long != 1 and last[end] == -2 and last[end - 1] != -2:
                best[end], last[end] = best[end - 1] + self.unknown_score, -1
        if last[n] == -2:
            raise ValueError(f"no way through {text[:40]!r}")
        out: list[int] = []
        end = n
        while end:
            t = last[end]
            if t >= 0:
                out.append(t)
                end -= self.length[t]
            else:
                raw = text[end - 1].encode("utf-8", "replace")
                out.extend(reversed([self.byte[b] for b in raw]) if self.byte else [self.unknown])
                end -= 1
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text. New segments are taken in order, as neighbours share the way to where they part."""
        cut = [self.segment.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        cache = self.cache
        for segment in sorted(s for s in set().union(*cut) if len(s) <= CACHED_CHARS and s not in cache):
            cache[segment]
        return [np.fromiter(chain.from_iterable(map(cache.__getitem__, c)), np.int32) for c in cut]


def raw_pieces(pieces: list[tuple[str, float, int]]) -> list[bytes]:
    """What each id stands for in a text, as bytes."""
    return [
        bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(BLANK, " ").encode() if k == NORMAL
        else " ⁇ ".encode() if k == UNKNOWN else b""
        for p, _, k in pieces
    ]


def decode_ids(ids: list[int], raw: list[bytes]) -> str:
    return b"".join(map(raw.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def _codec(shared, kind: str) -> Codec:
    """The codec of this Python worker, kept beside the pieces it is built from."""
    held = shared.value
    if kind not in held:
        held[kind] = Codec(held["pieces"], kind)
    return held[kind]


def _share(spark: SparkSession, pieces: list, most: int = 1_000_000):
    """Broadcast the pieces; a vocabulary has a fixed size, which is checked."""
    if len(pieces) > most:
        raise ValueError(f"{len(pieces)} pieces; at most {most} are broadcast")
    return spark.sparkContext.broadcast({"pieces": pieces})


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "token_ids", kind: str = "bpe", check: str | None = None) -> DataFrame:
    """``docs`` with the array column ``out``: the ids of ``text``. A column of that name is replaced.

    ``check`` names a boolean column: whether decoding the ids gives the text back (U+2581 reads back as a blank).
    Texts are taken a few at a time, long ones alone, and results leave in pieces of the same size.
    """
    pieces = load_pieces(path)
    shared = _share(docs.sparkSession, pieces)
    rest = docs.drop(out, *filter(None, [check]))
    rows = rest.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, kind)
        raw = raw_pieces(shared.value["pieces"])
        for batch in batches:
            column = batch.column(0).field(text)
            start, texts, size = 0, [], 0
            for i in range(batch.num_rows):
                texts.append(column[i].as_py() or "")
                size += len(texts[-1])
                if i + 1 == batch.num_rows or len(texts) >= TEXTS or size >= CHARS:
                    ids = codec.encode_all(texts)
                    good = [check is None or decode_ids(x.tolist(), raw) == t.replace(BLANK, " ") for x, t in zip(ids, texts)]
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                    part = batch.column(0).slice(start, len(texts))
                    yield pa.RecordBatch.from_arrays([part, lists, pa.array(good, pa.bool_())], names=["row", "ids", "good"])
                    start, texts, size = i + 1, [], 0

    schema = StructType([*rows.schema, StructField("ids", ArrayType(IntegerType())), StructField("good", BooleanType())])
    added = [F.col("ids").alias(out)] + ([F.col("good").alias(check)] if check else [])
    return rows.mapInArrow(run, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in rest.columns], *added)


def decode(tokens: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the string column ``out``: the text of ``ids``; null ids give an empty text."""
    raw = raw_pieces(load_pieces(path))
    shared = tokens.sparkSession.sparkContext.broadcast(raw)
    rest = tokens.drop(out)
    rows = rest.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row"), F.coalesce(F.col(f"`{ids}`"), F.array()).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        for batch in batches:
            lists = batch.column(1)
            texts = pa.array([decode_ids(lists[i].values.to_pylist(), raw) for i in range(batch.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["row", "text"])

    schema = rows.select("row").schema.add("text", StringType())
    return rows.mapInArrow(run, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in rest.columns], F.col("text").alias(out))
