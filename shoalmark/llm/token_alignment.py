"""Alignment of two tokenizers by inverted pair bitmaps.

Both tokenizers cut the bytes of a text (with one space before it) into tokens; places where tokens of both end cut the text
into groups, and every token of A in a group is linked with every token of B in it. A pair of ids counts in how many
documents of the whole corpus it is linked, and each document gets back the scores of its links.

* **Alignment** runs in the tasks. No token of either vocabulary goes on past another character into a space or line end,
  so a text is cut there into chunks that are tokenised and aligned by themselves; a task keeps the result of each
  distinct chunk (``TABLE_ENTRIES`` of them) and a text is put together from its chunks. Whether a vocabulary allows this is
  checked when it is read; if not, and for texts whose tokens do not give back their bytes, whole texts are tokenised.
* **Inverted bitmaps.** Documents of a task are numbered in segments (``POSTINGS`` entries or 65,536 documents). Within
  a segment the documents of a pair are one compressed bitmap, as batches come OR-ed together: a sorted list of
  16-bit numbers, or a bit field where that is shorter. How often a pair occurs in each of its documents is kept in
  multiplicity planes: bit k of the multiplicities, in the order of the bitmap's documents.
* **Counts.** The bitmaps of different segments hold different documents, so a pair's documents are the sum of popcounts, and
  its links the sum of popcounts of plane k times 2^k (``pair_table``). One number per pair and segment is summed, after
  a partial sum on the map side, so a pair that occurs everywhere is no hot key.
* **Scores return by the postings**: counts are joined to the slim (segment, pair) rows, dealt back to the segments, and each
  segment's bitmaps and planes spread them over its documents. A segment is bounded, so is that group. Nothing about documents
  or pairs reaches the driver.

Rows: a null or empty text, and one whose joined token bytes differ from space + text under either tokenizer, has no
tokens: zeros and an empty digest. Every row is a document of its own, repeated rows and ids included. Very long texts are
aligned chunk by chunk; a group of p and q distinct ids gives p * q pairs, whatever its length. Other columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import written
from .common import read
from .registry import query

#: (pair, document) entries of a segment.
POSTINGS = 2_000_000
#: Documents of a segment: their numbers take 16 bits.
SEGMENT_DOCS = 1 << 16
#: A task's table of aligned chunks is dropped and begun anew beyond this many.
TABLE_ENTRIES = 500_000
#: Longer chunks are aligned anew each time.
LONGEST_CHUNK = 100
#: Characters of text that are worked on at a time.
STEP = 2_000_000
#: White space that may begin a chunk, if no piece of the model goes on into it.
PLAIN_SPACE = " \n\t\r"
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def byte_level_bytes(token: str, table: dict[str, int] = {}) -> bytes:  # noqa: B006
    """Bytes of a byte-level token: printable bytes stand for themselves, the others for 256, 257, ..."""
    if not table:
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in plain]
        table.update({chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)})
    return bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()


def piece_bytes(piece: str) -> bytes:
    found = _BYTE.fullmatch(piece)
    return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()


def align(a: Sequence[int], b: Sequence[int], a_size: Sequence[int], b_size: Sequence[int]) -> Iterator[tuple[list[int], list[int]]]:
    """Groups of two token lists over the same bytes, cut where both end; sizes are in bytes."""
    i = j = at_a = at_b = first_a = first_b = 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            at_a, i = at_a + a_size[i], i + 1
        else:
            at_b, j = at_b + b_size[j], j + 1
        if at_a == at_b and i > first_a and j > first_b:
            yield list(a[first_a:i]), list(b[first_b:j])
            first_a, first_b = i, j


@dataclass
class Chunk:
    """What a stretch of text adds to its document."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    #: (a << 32 | b) of each linked pair, and how often
    pairs: list[int]
    times: list[int]


class Aligner:
    def __init__(self, vocabulary: str, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        self.a = Tokenizer.from_str(vocabulary)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = SentencePieceProcessor(model_proto=model)
        names = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(names.values()) + 1)  # by id
        for token, i in names.items():
            self.a_bytes[i] = byte_level_bytes(token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        #: every id followed by each mark that can stand behind it
        self.marked = [f"{i}{mark}" for i in range(max(len(self.a_bytes), len(pieces))) for mark in ",|;\n"]
        pre = spec.get("pre_tokenizer") or {}
        plain = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                 and not spec.get("normalizer"))
        # a chunk is tokenised behind an x, whose one piece is cut off again
        self.guard = self.b.encode("x")
        texts = [p.replace("▁", " ") for p in pieces]
        cuts = "".join(c for c in PLAIN_SPACE if not any(re.search(r"\S" + c, t) for t in texts if c in t[1:]))
        #: runs of white space and what follows, cut where white space of ``cuts`` follows another character
        self.cut = re.compile(rf"\s*\S+(?:[^\S{cuts}]\s*\S*)*|\s+")
        # white space must be kept as it is
        self.chunked = (plain and " " in cuts and len(self.guard) == 1 and self.b_bytes[self.guard[0]] == b" x"
                        and b"".join(self.b_bytes[i] for i in self.b.encode("x  y\n z ")) == b" x  y\n z ")
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.strings: list[str] = []
        # per chunk: n_a, n_b, n_groups, n_links, whether its bytes agree; then its pairs as one run
        self.counts = np.zeros((0, 5), np.int64)
        self.starts, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def aligned(self, a: list[int], b: list[int], raw: bytes) -> Chunk | None:
        """None if the tokens do not give back the bytes."""
        parts_a, parts_b = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return None
        pairs: Counter = Counter()
        text, n_groups, n_links = [], 0, 0
        for own, other in align(a, b, [len(p) for p in parts_a], [len(p) for p in parts_b]):
            text.append(f"{','.join(map(str, own))}|{','.join(map(str, other))}")
            n_groups, n_links = n_groups + 1, n_links + len(own) * len(other)
            if len(own) == len(other) == 1:
                pairs[own[0] << 32 | other[0]] += 1
            else:
                right = Counter(other)
                for x, n in Counter(own).items():
                    for y, m in right.items():
                        pairs[x << 32 | y] += n * m
        return Chunk(len(a), len(b), n_groups, n_links, ";".join(text), list(pairs), list(pairs.values()))

    def tokens(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of chunks that begin with white space; none of B where the guard is not a piece of its own."""
        a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        b = self.b.encode(["x" + p for p in parts], num_threads=1)
        return a, [y[1:] if y[:1] == self.guard else [] for y in b]

    def chunk(self, parts: list[str]) -> list[Chunk | None]:
        return [self.aligned(x, y, p.encode()) for p, x, y in zip(parts, *self.tokens(parts))]

    def many(self, parts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts, group strings, pairs per chunk, pairs and their times of many short chunks at once.

        The chunks are laid end to end: ends of tokens are places in one run of bytes, and as chunks end where tokens
        of both end, no group crosses a border.
        """
        raw = [p.encode() for p in parts]
        a, b = self.tokens(parts)
        n = len(parts)
        agree = np.ones(n, bool)
        if not all(b"".join(map(by.__getitem__, chain.from_iterable(ids))) == b"".join(raw) for ids, by in ((a, self.a_bytes), (b, self.b_bytes))):
            agree = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, r in zip(a, b, raw)])
        at = np.flatnonzero(agree)
        if len(at) < n:
            a, b, raw = [a[k] for k in at], [b[k] for k in at], [raw[k] for k in at]
        n_a, n_b, size = (np.fromiter(map(len, x), np.int64, len(at)) for x in (a, b, raw))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(k.sum())) for x, k in ((a, n_a), (b, n_b)))
        end_a, end_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        cut = end_a[np.isin(end_a, end_b)]
        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        p, q = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
        first_a, first_b = np.cumsum(p) - p, np.cumsum(q) - q
        owner = np.searchsorted(np.cumsum(size), cut)
        counts = np.zeros((n, 5), np.int64)
        counts[at] = np.stack([n_a, n_b, np.bincount(owner, minlength=len(at)), np.bincount(owner, p * q, len(at)).astype(np.int64), np.ones(len(at), np.int64)], axis=1)
        # all pairs of a group, then each pair of a chunk once
        group = np.repeat(np.arange(len(cut)), p * q)
        inside = np.arange(len(group)) - np.repeat(np.cumsum(p * q) - p * q, p * q)
        pair = ids_a[first_a[group] + inside // q[group]] << 32 | ids_b[first_b[group] + inside % q[group]]
        own = at[owner[group]]
        order = np.lexsort((pair, own))
        pair, own = pair[order], own[order]
        start = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (own[1:] != own[:-1]))) if len(pair) else np.zeros(0, np.int64)
        # ids in the order of the groups' text, each with the mark behind it
        code = np.zeros(len(ids_a) + len(ids_b), np.int64)
        i, j = np.arange(len(ids_a)) - first_a[group_a], np.arange(len(ids_b)) - first_b[group_b]
        ends = np.append(owner[1:] != owner[:-1], True)[:len(cut)]
        code[first_a[group_a] + first_b[group_a] + i] = ids_a * 4 + (i == p[group_a] - 1)
        code[first_a[group_b] + first_b[group_b] + p[group_b] + j] = ids_b * 4 + np.where(j == q[group_b] - 1, 2 + ends[group_b], 0)
        text = "".join(map(self.marked.__getitem__, code.tolist())).split("\n")
        strings = [""] * n
        for k, t in zip(at.tolist(), text):
            strings[k] = t
        return counts, strings, np.bincount(own[start], minlength=n), pair[start], np.diff(np.append(start, len(pair)))

    def whole(self, text: str) -> Chunk | None:
        return self.aligned(self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode())

    def split(self, text: str) -> list[str]:
        return self.cut.findall(" " + text)

    def learn(self, parts: set[str]) -> None:
        """Bring new short chunks into the table."""
        new = [p for p in parts if p not in self.number and len(p) <= LONGEST_CHUNK]
        found = [(new[i:i + 20_000], *self.many(new[i:i + 20_000])) for i in range(0, len(new), 20_000)]
        if not found:
            return
        for some, _, strings, _, _, _ in found:
            self.number.update(zip(some, range(len(self.strings), len(self.strings) + len(some))))
            self.strings += strings
        counts, sizes, pairs, times = (np.concatenate([f[k] for f in found]) for k in (1, 3, 4, 5))
        self.counts = np.concatenate([self.counts, counts])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])


class _Holder:
    """What the tasks share; a worker builds its aligner once and keeps it with its table."""

    def __init__(self, vocabulary: str, model: bytes):
        self.vocabulary, self.model, self._made = vocabulary, model, None

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "model": self.model, "_made": None}

    def aligner(self) -> Aligner:
        if self._made is None:
            self._made = Aligner(self.vocabulary, self.model)
        return self._made


# ---- bitmaps ------------------------------------------------------------------------------------

def pack(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, n_docs: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """(pair, documents, bitmap, planes) of entries with distinct (pair, doc): first those kept as lists, then bit fields."""
    order = np.lexsort((doc, pair))
    pair, doc, times = pair[order], doc[order].astype("<u2"), times[order]
    start = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(pair)))
    width = (n_docs + 7) // 8
    most = np.maximum.reduceat(times, start) if len(start) else times
    planes = [b""] * len(start)
    for k in np.flatnonzero(most > 1):
        t = times[start[k]:start[k] + size[k]]
        planes[k] = b"".join(np.packbits((t >> bit) & 1 > 0, bitorder="little").tobytes() for bit in range(int(most[k]).bit_length()))
    fields = 2 * size > width
    for kind in (False, True):
        own = np.flatnonzero(fields == kind)
        if len(own) == 0:
            continue
        if kind:
            maps = []
            for k in own:
                bits = np.zeros(width * 8, bool)
                bits[doc[start[k]:start[k] + size[k]]] = True
                maps.append(np.packbits(bits, bitorder="little").tobytes())
            maps = pa.array(maps, pa.binary())
        else:
            held = np.repeat(~fields, size)
            ends = np.append(0, np.cumsum(size[own] * 2)).astype(np.int32)
            maps = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(doc[held].tobytes())])
        yield pair[start[own]], size[own], maps, pa.array([planes[k] for k in own], pa.binary())


def unpack(size: np.ndarray, maps: list[bytes], planes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents and multiplicities of postings, one after another."""
    docs, times = np.zeros(int(size.sum()), np.int64), np.ones(int(size.sum()), np.int64)
    at = 0
    for n, held, extra in zip(size.tolist(), maps, planes):
        docs[at:at + n] = (np.frombuffer(held, "<u2") if len(held) == 2 * n
                           else np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little")))
        if extra:
            bits = np.unpackbits(np.frombuffer(extra, np.uint8).reshape(-1, (n + 7) // 8), axis=1, bitorder="little")[:, :n]
            times[at:at + n] = (bits.astype(np.int64) << np.arange(len(bits))[:, None]).sum(axis=0)
        at += n
    return docs, times


def links_of(size: int, planes: bytes) -> int:
    """Links of a posting: popcounts of its planes by their weight."""
    if not planes:
        return size
    bits = np.unpackbits(np.frombuffer(planes, np.uint8).reshape(-1, (size + 7) // 8), axis=1).sum(axis=1)
    return int((bits.astype(np.int64) << np.arange(len(bits))).sum())


# ---- the job ------------------------------------------------------------------------------------

_DOC = ["n_a", "n_b", "n_groups", "n_links"]


class _Segments:
    """Turns batches of texts into rows of documents and of postings."""

    def __init__(self, aligner: Aligner, schema: pa.Schema, partition: int, postings: int):
        self.aligner, self.schema, self.limit = aligner, schema, postings
        self.segment = partition << 32
        self._open()

    def _open(self) -> None:
        self.n_docs = self.entries = 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            pair, doc, times = (np.concatenate(p) for p in zip(*self.held))
            for pairs, size, maps, planes in pack(pair, doc, times, self.n_docs):
                yield self._batch(len(pairs), pair=pa.array(pairs), n=pa.array(size.astype(np.int32)), docs=maps, planes=planes)
        self.segment += 1
        self._open()

    def _batch(self, rows: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["segment"] = pa.array(np.full(rows, self.segment, np.int64))
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in self.schema], schema=self.schema)

    def add(self, ids: pa.Array, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and chars < STEP and self.n_docs + j - i < SEGMENT_DOCS:
                chars += len(texts[j] or "")
                j += 1
            yield from self._step(ids.slice(i, j - i), texts[i:j])
            i = j
            if self.entries >= self.limit or self.n_docs >= SEGMENT_DOCS:
                yield from self.close()

    def _step(self, ids: pa.Array, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        al, n = self.aligner, len(texts)
        if len(al.number) > TABLE_ENTRIES:
            al._forget()
        split = [al.split(t) if t and al.chunked else [] for t in texts]
        al.learn(set().union(*split))
        counts, digests = np.zeros((n, 4), np.int64), [""] * n
        code_doc, code, own = [], [], []  # known chunks per document; (pair, document, times) of the others
        for d, (text, parts) in enumerate(zip(texts, split)):
            if not text:
                continue
            codes = list(map(al.number.get, parts))
            extra = {}
            if None in codes:  # long chunks are not in the table
                long = [k for k, c in enumerate(codes) if c is None]
                extra = dict(zip(long, al.chunk([parts[k] for k in long])))
            short = np.array([c for c in codes if c is not None] if extra else codes, np.int64)
            if not parts or not al.counts[short, 4].all() or None in extra.values():
                one = al.whole(text)  # the whole text decides whether its bytes come back
                if one is None:
                    continue
                extra, short, strings = {0: one}, np.zeros(0, np.int64), [one.groups]
            else:
                strings = [extra[k].groups if c is None else al.strings[c] for k, c in enumerate(codes)] if extra else map(al.strings.__getitem__, codes)
            digests[d] = hashlib.sha256(";".join(strings).encode()).hexdigest()
            counts[d] = al.counts[short, :4].sum(axis=0)
            for c in extra.values():
                counts[d] += (c.n_a, c.n_b, c.n_groups, c.n_links)
                own.append((np.array(c.pairs, np.int64), np.full(len(c.pairs), d), np.array(c.times, np.int64)))
            code_doc.append(np.full(len(short), d))
            code.append(short)
        self._post(n, code_doc, code, own)
        yield self._batch(n, doc_id=ids, doc=pa.array(np.arange(self.n_docs, self.n_docs + n, dtype=np.int32)),
                          groups_sha256=pa.array(digests, pa.string()), **{c: pa.array(counts[:, k].copy()) for k, c in enumerate(_DOC)})
        self.n_docs += n

    def _post(self, n: int, code_doc: list, code: list, own: list) -> None:
        """Collect (pair, document, times) of a step, each pair and document once."""
        al = self.aligner
        pair, doc, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if code:
            d, c = np.concatenate(code_doc), np.concatenate(code)
            key, often = np.unique(d * (len(al.strings) + 1) + c, return_counts=True)
            d, c = np.divmod(key, len(al.strings) + 1)
            size = al.starts[c + 1] - al.starts[c]
            at = np.repeat(al.starts[c] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            pair.append(al.pairs[at])
            doc.append(np.repeat(d, size))
            times.append(al.times[at] * np.repeat(often, size))
        for p, d, t in own:
            pair.append(p)
            doc.append(d)
            times.append(t)
        pair, doc, times = np.concatenate(pair), np.concatenate(doc), np.concatenate(times)
        if len(pair) == 0:
            return
        order = np.lexsort((pair, doc))
        pair, doc, times = pair[order], doc[order], times[order]
        start = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])))
        self.held.append((pair[start], doc[start] + self.n_docs, np.add.reduceat(times, start)))
        self.entries += len(start)


def inverted(docs: DataFrame, vocabulary: str, model: bytes, key: str = "doc_id", text: str = "text", postings: int = POSTINGS) -> DataFrame:
    """Written table of documents (``doc`` not null) and postings (``pair`` not null) of every segment."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(_Holder(vocabulary, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        made = None
        for batch in batches:
            if made is None:
                schema = pa.schema([("segment", pa.int64()), ("doc_id", batch.schema.field(0).type), ("doc", pa.int32()),
                                    *[(c, pa.int64()) for c in _DOC], ("groups_sha256", pa.string()), ("pair", pa.int64()),
                                    ("n", pa.int32()), ("docs", pa.binary()), ("planes", pa.binary())])
                made = _Segments(shared.value.aligner(), schema, TaskContext.get().partitionId(), postings)
            yield from made.add(batch.column(0), batch.column(1).to_pylist())
        if made is not None:
            yield from made.close()

    return written(rows.mapInArrow(run, f"segment long, doc_id {kind}, doc int, {', '.join(f'{c} long' for c in _DOC)}, "
                                        "groups_sha256 string, pair long, n int, docs binary, planes binary"), "pair-bitmaps")


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, count, best): documents of each pair, and whether that is the highest count of its A id."""
    counts = table.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("count"))
    counts = written(counts.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # one row per id of the vocabulary
    return counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))


def pair_table(docs: DataFrame, vocabulary: str, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, n_docs, n_links, best) of every linked pair of ids."""
    table = inverted(docs, vocabulary, model, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [links_of(n, p) for n, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(links, pa.int64())], ["pair", "n_links"])

    links = (table.where("pair IS NOT NULL").select("pair", "n", "planes").mapInArrow(run, "pair long, n_links long")
             .groupBy("pair").agg(F.sum("n_links").alias("n_links")))
    return pair_counts(table).join(links, "pair").select(
        F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"),
        F.col("count").alias("n_docs"), "n_links", (F.col("best") == 1).alias("best"))


def align_tokenizers(docs: DataFrame, vocabulary: str, model: bytes, key: str = "doc_id", text: str = "text",
                     postings: int = POSTINGS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``vocabulary`` is the content of a byte-level tokenizer file (A), ``model`` that of a piece model (B)."""
    table = inverted(docs, vocabulary, model, key, text, postings)
    scores = pair_counts(table).withColumnRenamed("pair", "of")
    slim = (table.where("pair IS NOT NULL").select(F.col("segment").alias("to"), F.col("pair").alias("of"))
            .join(scores, "of").select("to", "of", "count", "best"))
    kind = table.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *_DOC, "n_best", "count_sum", "groups_sha256"]

    def spread(rows: pa.Table, scored: pa.Table) -> pa.Table:
        own = rows.filter(pc.is_valid(rows["doc"]))
        posted = rows.filter(pc.is_valid(rows["pair"]))
        at = own["doc"].to_numpy()
        total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if len(posted):
            pairs, order = posted["pair"].to_numpy(), np.argsort(scored["of"].to_numpy())
            place = order[np.searchsorted(scored["of"].to_numpy(), pairs, sorter=order)]
            size = posted["n"].to_numpy().astype(np.int64)
            docs_of, times = unpack(size, posted["docs"].to_pylist(), posted["planes"].to_pylist())
            np.add.at(total, docs_of, times * np.repeat(scored["count"].to_numpy()[place], size))
            np.add.at(best, docs_of, times * np.repeat(scored["best"].to_numpy()[place], size))
        return pa.table([own["doc_id"], *[own[c] for c in _DOC], pa.array(best[at]), pa.array(total[at]), own["groups_sha256"]], names=names)

    return (table.groupBy("segment").cogroup(slim.groupBy("to")).applyInArrow(
        spread, f"doc_id {kind}, {', '.join(f'{c} long' for c in _DOC)}, n_best long, count_sum long, groups_sha256 string"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return align_tokenizers(read(spark, sf_dir, "documents"), vocabulary, model)
