"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last ``WINDOW`` bytes cuts a text wherever its low bits vanish, so equal
passages of different documents are cut at equal places and give equal chunks, which 128-bit digests
name.

* Shared chunks.  A first job counts the digests of all chunks (a row of 24 bytes per distinct chunk and
  task is shuffled, no text).  The ``SHARED`` chunks that occur most often, twice at least, are encoded
  once per cluster and their ids broadcast: ``SHARED`` times a chunk's ids, whatever the input
  (``MOST`` bytes of text at most for each).
* Other chunks.  A worker remembers chunks it met lately (within fixed bounds) and encodes the rest,
  with a memo of white-space-separated pieces.
* Joins.  A cut may fall inside a piece; then the parts on either side of the cut (of several cuts, if
  a piece is longer than a chunk) are put together and encoded again with the whole pieces beside them,
  until these agree with the ids that the chunks gave them.  ASCII white space separates pieces in the
  tokenizer as well (no merge, normalisation or pattern reaches over it), so agreement is exact.

Every piece is encoded in one join at most, and is a neighbour in two, so time is linear in a text's
length whatever it holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, quoted
from .worker import batches_of
from .worker import keep as kept_by_worker

WINDOW, MASK, LEAST = 16, (1 << 9) - 1, 64
#: Chunks that are encoded for all, and the most bytes of one; distinct digests a task holds before it sends them off.
SHARED, MOST, FLUSH = 1 << 15, 1 << 13, 1 << 17
#: Bounds of what a worker remembers: pieces, their longest length, and bytes of chunks.
PIECES, PIECE_BYTES, CHUNK_BYTES = 3 << 16, 64, 1 << 23
#: Bytes of text that are cut and encoded together; a longer text is taken alone.
STEP = 1 << 20
SPACE = b" \t\n\r\x0b\x0c"
#: Marks that are tokens of their own after a run of letters.
MARKS = ",.;:!?"
_GEAR = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64)


def cuts(text: bytes) -> list[int]:
    """Where the chunks of a text end; the last is its length."""
    n = len(text)
    if n <= LEAST + WINDOW:
        return [n]
    rolling, width = _GEAR[np.frombuffer(text, np.uint8)], 1
    while width < WINDOW:  # windows of twice the width
        rolling = (rolling[:-width] << np.uint64(width)) + rolling[width:]
        width *= 2
    high = rolling >> np.uint64(8)  # bits that all bytes of the window reach
    out, last = [], 0
    for end in (np.flatnonzero((high & np.uint64(MASK)) == 0) + WINDOW).tolist():
        while end < n and text[end] & 0xC0 == 0x80:  # a character is never cut
            end += 1
        if end - last >= LEAST and end < n:
            out.append(end)
            last = end
    return [*out, n]


def chunks_of(text: bytes) -> list[bytes]:
    """The chunks of a text in order; none of an empty one."""
    ends = cuts(text)
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False) if a < b]


def chunk_name(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


class Part(NamedTuple):
    """A chunk's ids, and its first and last piece where a cut went through them (else empty): their ids don't count."""

    ids: bytes
    head: bytes
    tail: bytes


class Seam(NamedTuple):
    """A piece that cuts went through, and a piece on either side of it (empty where there is none at hand)."""

    before: bytes
    joined: bytes
    after: bytes


def parts_of(chunks: list[bytes], ids: list[bytes]) -> list[Part | Seam]:
    """What a text's ids are put together from, given those of its chunks."""
    out: list[Part | Seam] = []
    rope: list[bytes] = []  # what the chunks so far hold of a piece that goes on
    before = b""
    for k, (chunk, own) in enumerate(zip(chunks, ids, strict=True)):
        goes_on = k + 1 < len(chunks) and chunk[-1] not in SPACE and chunks[k + 1][0] not in SPACE
        head = tail = b""
        if rope:
            first = chunk.split(None, 2)[:2]
            rope.append(first[0])
            if len(first) == 1 and goes_on:
                continue
            out.append(Seam(before, b"".join(rope), first[1] if len(first) == 2 else b""))
            rope = []
            if len(first) == 1:
                continue
            head = first[0]
        if goes_on:
            last = chunk.rsplit(None, 2)[-2:]
            before, tail = last[0] if len(last) == 2 else b"", last[-1]
            rope = [tail]
        out.append(Part(own, head, tail))
    return out


def _slices(items: list, size: int = 4096) -> Iterator[list]:
    for at in range(0, len(items), size):
        yield items[at : at + size]


def _offsets_hold(text: str) -> bool:
    """Whether normalisation changes no lengths and no special token may occur, so that offsets tell whose a token is."""
    return "<|" not in text and (text.isascii() or is_normalized("NFC", text) and len(text.lower()) == len(text))


class ChunkCoder:
    """Encodes and decodes as the tokenizer in a file does, without special tokens added.

    Ids are kept as the bytes of 32-bit integers.
    """

    def __init__(self, path: str, shared: dict[bytes, bytes] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        if self.tokenizer.decoder is not None or self.tokenizer.pre_tokenizer is None:
            raise ValueError("this tokenizer's words are not separated by white space")
        self.pieces: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.shared, self.most = shared or {}, PIECES
        self.chunks: dict[bytes, bytes] = {}
        self.held = 0
        self.reused = self.encoded = self.repaired = 0

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of each of some pieces (whose offsets hold), from one call."""
        encoding = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begin = np.array([b for b, _ in encoding.offsets], np.int64)
        return _dealt(encoding.ids, np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts])).tolist())

    def learn(self, wanted: Iterable[bytes]) -> None:
        """Encode pieces that aren't remembered, many in one call."""
        pieces, older = self.pieces, self.older
        new = set(wanted).difference(pieces)
        back = [p for p in new if p in older]
        pieces.update(zip(back, map(older.__getitem__, back), strict=True))
        fresh = list(new.difference(back))
        runs: dict[bytes, str] = {}  # pieces of letters only
        ended: list[tuple[bytes, bytes, str]] = []  # letters and a mark at the end, encoded one by one
        together, alone = [], []
        # Pieces have no white space, so all can be decoded in one go.
        for p, text in zip(fresh, b"\n".join(fresh).decode("utf-8", "replace").split("\n") if fresh else [], strict=True):
            if text.isalpha() and text.isascii():
                runs[p] = text
            elif not _offsets_hold(text):
                alone.append((p, text))
            elif text.isalpha():
                runs[p] = text
            elif text[-1] in MARKS and text[:-1].isalpha():
                core = p[:-1]
                ended.append((p, core, text[-1]))
                if core in older:
                    pieces[core] = older[core]
                elif core not in pieces:
                    runs[core] = text[:-1]
            else:
                together.append((p, text))
        for some in _slices(list(runs.items())):
            encoding = self.tokenizer.encode(" ".join(t for _, t in some), add_special_tokens=False)
            numbers = encoding.word_ids
            if not numbers or numbers[-1] != len(some) - 1:  # not a word each
                together += some
                continue
            found = _dealt(encoding.ids, np.searchsorted(numbers, np.arange(len(some)), side="right").tolist())
            pieces.update(zip((p for p, _ in some), found, strict=True))
        for some in _slices(together):
            pieces.update(zip((p for p, _ in some), self._together([t for _, t in some]), strict=True))
        for p, text in alone:
            pieces[p] = self._plain(text)
        for p, core, mark in ended:
            if mark not in self.marks:
                self.marks[mark] = self._plain(mark)
            pieces[p] = pieces[core] + self.marks[mark]

    def repair(self, seams: Iterable[Seam]) -> None:
        """Encode joined pieces together with those beside them, which must come out as their chunks have them.

        Joined pieces that are remembered did so before.
        """
        new = {}
        for seam in seams:
            if seam.joined in self.older:
                self.pieces[seam.joined] = self.older[seam.joined]
            elif seam.joined not in self.pieces:
                new[seam.joined] = seam
        self.repaired += len(new)
        for some in _slices(list(new.values()), 1024):
            texts = [[p.decode("utf-8", "replace") for p in seam if p] for seam in some]
            bulk = [_offsets_hold("".join(own)) for own in texts]
            dealt = iter(self._together([t for own, b in zip(texts, bulk, strict=True) if b for t in own]))
            for seam, own, b in zip(some, texts, bulk, strict=True):
                ids = b"".join([next(dealt) for _ in own]) if b else self._plain(" ".join(own))
                head, tail = self.pieces[seam.before], self.pieces[seam.after]
                if not (ids.startswith(head) and ids.endswith(tail) and len(head) + len(tail) <= len(ids)):
                    raise ValueError("the tokenizer merges across white space")
                self.pieces[seam.joined] = ids[len(head) : len(ids) - len(tail)]

    def forget(self) -> None:
        """Keep to the bounds: what was used since the last time outlives what was not."""
        if len(self.pieces) > self.most:
            for p in [p for p in self.pieces if len(p) > PIECE_BYTES]:
                del self.pieces[p]
            self.older, self.pieces = self.pieces, {b"": b""}
        if self.held > CHUNK_BYTES:
            self.chunks, self.held = {}, 0

    def chunk_ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk on its own: shared, remembered, or encoded now."""
        names = [chunk_name(c) for c in chunks]
        new = {n: c for n, c in zip(names, chunks, strict=True) if n not in self.shared and n not in self.chunks}
        self.encoded += len(new)
        self.reused += len(names) - len(new)
        words = {n: c.split() for n, c in new.items()}
        self.learn(set().union(*words.values()))
        for n, own in words.items():
            self.chunks[n] = b"".join(map(self.pieces.__getitem__, own))
            self.held += len(self.chunks[n]) + 150
        return [self.shared[n] if n in self.shared else self.chunks[n] for n in names]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each whole text."""
        self.forget()
        cut = [chunks_of(t) for t in texts]
        ids = iter(self.chunk_ids([c for own in cut for c in own]))
        parts = [parts_of(own, [next(ids) for _ in own]) for own in cut]
        seams = [x for own in parts for x in own if isinstance(x, Seam)]
        self.learn({p for own in parts for x in own for p in ((x.before, x.after) if isinstance(x, Seam) else (x.head, x.tail))})
        self.repair(seams)
        found = self.pieces
        out = [b"".join([found[x.joined] if isinstance(x, Seam) else x.ids[len(found[x.head]) : len(x.ids) - len(found[x.tail])] for x in own]) for own in parts]
        for p in [p for seam in seams for p in seam if len(p) > PIECE_BYTES]:
            found.pop(p, None)
        return out

    def encode(self, text: bytes) -> list[int]:
        """The ids of one whole text."""
        return np.frombuffer(self.encode_all([text])[0], np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The tokenizer's decode(ids, skip_special_tokens=False): without a decoder, tokens joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


def _dealt(ids: list[int], ends: list[int]) -> list[bytes]:
    every = np.array(ids, np.int32).tobytes()
    return [every[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]


_coders: dict[str, ChunkCoder] = {}


def coder(path: str, shared: dict[bytes, bytes] | None = None, most: int = PIECES) -> ChunkCoder:
    """This worker's coder; it outlives tasks of this operator, with the shared chunks and the bound on pieces of the last."""
    if path not in _coders:
        _coders[path] = ChunkCoder(path)
        kept_by_worker("bpe", _coders.clear)
    own = _coders[path]
    own.most = most
    if shared is not None:
        own.shared = shared
    return own


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column, null as empty, about STEP bytes at a time."""
    column = column.cast(pa.large_binary())
    at, n = 0, len(column)
    while at < n:
        some, size = [], 0
        while at < n and (not some or size < STEP):
            some.append(column[at].as_py() or b"")
            size += len(some[-1])
            at += 1
        yield some


def _arrays(path: str, texts: pa.Array, shared: dict[bytes, bytes] | None = None, most: int = PIECES) -> Iterator[np.ndarray]:
    own = coder(path, shared, most)
    for some in _texts(texts):
        for ids in own.encode_all(some):
            yield np.frombuffer(ids, np.int32)


def encode_texts(path: str, texts: pa.Array, shared: dict[bytes, bytes] | None = None) -> Iterator[list[int]]:
    """Ids of each text; null counts as empty."""
    return (ids.tolist() for ids in _arrays(path, texts, shared))


def _count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of chunks and how often a task met them, summed up as far as FLUSH of them go."""
    counts: dict[bytes, int] = {}

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["chunk", "n"])

    for batch in batches:
        for some in _texts(batch.column(0)):
            for text in some:
                for chunk in chunks_of(text):
                    if len(chunk) <= MOST:
                        name = chunk_name(chunk)
                        counts[name] = counts.get(name, 0) + 1
            if len(counts) >= FLUSH:
                yield flush()
                counts = {}
    if counts:
        yield flush()


def shared_chunks(docs: DataFrame, path: str, text_col: str = "text", most: int = SHARED) -> dict[bytes, bytes]:
    """Ids of the chunks of ``docs`` that occur most often, twice at least, by digest.

    A histogram of counts (eight steps to a power of two) tells how often a chunk must occur so that
    ``most`` at most do.  Bounded by ``most`` times the ids of ``MOST`` bytes, whatever the input.
    """
    scratch = Scratch(docs.sparkSession, "chunks")
    texts = docs.select(F.col(quoted(text_col)).cast("string").alias("text"))
    counted = texts.mapInArrow(batches_of("bpe", _count_batches), "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n")).where("n > 1")
    counted = scratch.keep(counted.select("chunk", F.floor(F.log2("n") * 8).cast("int").alias("step")), "counted")
    level, total = None, 0
    for r in counted.groupBy("step").count().orderBy(F.desc("step")).collect():  # 8 rows for each power of two
        total += r["count"]
        if total > most:
            break
        level = r["step"]
    wanted = {bytes(r["chunk"]) for r in counted.where(F.col("step") >= level).collect()} if level is not None else set()
    scratch.end()
    if not wanted:
        return {}
    known = docs.sparkSession.sparkContext.broadcast(wanted)  # ``most`` digests at most

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each wanted chunk that a task meets, once."""
        left = set(known.value)
        for batch in batches:
            for some in _texts(batch.column(0)):
                found = {}
                for text in some:
                    for chunk in chunks_of(text):
                        name = chunk_name(chunk)
                        if name in left:
                            left.discard(name)
                            found[name] = chunk
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["chunk", "text"])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, {})
        for batch in batches:
            ids = own.chunk_ids(batch.column(1).to_pylist())
            own.forget()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["chunk", "ids"])

    found = texts.mapInArrow(batches_of("bpe", fetch), "chunk binary, text binary").groupBy("chunk").agg(F.first("text").alias("text"))
    return {bytes(r["chunk"]): bytes(r["ids"]) for r in found.mapInArrow(batches_of("bpe", encode), "chunk binary, ids binary").collect()}


def _numbered(df: DataFrame) -> DataFrame:
    """Columns by number, so that no name occurs twice."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) and ``out`` array<int>: the ids of each whole text.

    Null and empty texts and those of white space give empty arrays.  A column named ``out`` is
    replaced; all others pass through, rows that repeat included.  An empty table stays empty.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != out]
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path, text_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(batch: pa.RecordBatch, ids: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*kept, out])

        for whole in batches:
            begin, waiting, size = 0, [], 0
            # The worker holds ids to return as well, so it remembers less.
            for at, ids in enumerate(_arrays(path, whole.column(len(kept)), shared.value, PIECES // 3)):
                waiting.append(ids)
                size += len(ids)
                if size >= STEP // 4:
                    yield packed(whole.slice(begin, at + 1 - begin), waiting)
                    begin, waiting, size = at + 1, [], 0
            if waiting:
                yield packed(whole.slice(begin), waiting)

    chosen = docs.select(*map(quoted, kept))
    schema = chosen.schema.add(out, T.ArrayType(T.IntegerType()))
    return _numbered(docs.select(*map(quoted, kept), F.col(quoted(text_col)).cast("string"))).mapInArrow(batches_of("bpe", run), schema)


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with a column ``out`` string: what the ids decode to.  Null ids decode to ''."""
    kept = [c for c in docs.columns if c != out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [own.decode(x.as_py() or ()) for x in batch.column(len(kept))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*kept, out])

    schema = docs.select(*map(quoted, kept)).schema.add(out, "string")
    return _numbered(docs.select(*map(quoted, kept), quoted(ids_col))).mapInArrow(batches_of("bpe", run), schema)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 of ``encode`` and then ``decode``, in one pass.

    Ids and decoded texts stay in the worker.  Null counts as empty; other columns are ignored; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path, text_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        numbers = [str(i) for i in range(len(own.names))]
        for batch in batches:
            counts, ids_digests, decoded_digests = [], [], []
            for ids in encode_texts(path, batch.column(1), shared.value):
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(" ".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
                decoded_digests.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(decoded_digests, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return chosen.mapInArrow(batches_of("bpe", run), f"{quoted(id_col)} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
