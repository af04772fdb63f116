"""Secret scans with a token-efficiency test.

Three patterns find assignments, access keys and long hexadecimal strings.  Beyond them every run of
key characters is tested: text that a tiktoken vocabulary was made for takes few tokens, random
strings take many.  A run is a secret (kind ``token``) if it has at least ``LEAST`` characters and a
letter, its characters per token are at most ``RATIO``, and it is neither a known digest
(a hexadecimal string of a usual digest's length, or one in base64 after its kind) nor an identifier (a UUID, a time stamp, a
name of words and short numbers).  Of a run that passes as a whole, every stretch of tokens of at least
``LEAST`` characters and all that is between two separators is tested alike, so plain words joined to a
random string don't hide it: stretches that overlap are one secret, up to the next separators and without the words before and after it that a separator parts from it.
Time is linear in the length of a run.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import quoted, small_batches
from .worker import batches_of, keep

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Least lengths of the three base kinds.
SIZES = (6, 20, 24)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST, RATIO = 16, 2.0
#: Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal.
DIGESTS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: A digest in base64 as web pages name it.
INTEGRITY = re.compile(r"sha256-[A-Za-z0-9+/]{43}=|sha384-[A-Za-z0-9+/]{64}|sha512-[A-Za-z0-9+/]{86}==")
#: Names: words of letters (a capital at most at their start, or all capitals) with at most 4 digits after each, and
#: numbers of at most 8 digits or time stamps, parted by separators.  Possessive throughout: each character can be matched in one way only.
_STAMP = r"\d{8}T\d{6}\d{0,6}+Z?"
NAME = re.compile(rf"[_/=+-]*+(?:[A-Z]?[a-z]++\d{{0,4}}+|[A-Z]++\d{{0,4}}+|{_STAMP})(?:[_/=+-]++(?:[A-Z]?[a-z]++\d{{0,4}}+|[A-Z]++\d{{0,4}}+|{_STAMP}|\d{{1,8}}+))*+[_/=+-]*+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost non-overlapping per kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SIZES[0]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= SIZES[1]]
    out += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


#: Maximal runs, so a least length in the pattern drops the same matches as a test afterwards.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_LETTER = re.compile(r"[A-Za-z]")
#: Inside a run: UUIDs, hexadecimal strings between separators, what is between separators, and plain words at either end.
_UUID_IN = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])")
_HEX_IN = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,128}(?![A-Za-z0-9])")
_PIECE = re.compile(r"[A-Za-z0-9]+")
_WORD_FIRST = re.compile(r"([A-Z]?[a-z]*|[A-Z]*)[_/=+-]+")
_WORD = re.compile(r"[A-Z]?[a-z]*|[A-Z]*")
_SEPARATORS, _LETTERS = frozenset("_/=+-"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


class Efficiency:
    """Characters per token under a tiktoken vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def sizes(self, run: str) -> list[int]:
        """Characters of each token of a run of ASCII characters."""
        return [len(self.encoding.decode_single_token_bytes(t)) for t in self.encoding.encode_ordinary(run)]

    def __call__(self, run: str) -> float:
        return len(run) / len(self.encoding.encode_ordinary(run))


def is_secret(run: str, efficiency: Efficiency) -> bool:
    if len(run) < LEAST or not _LETTER.search(run) or UUID.fullmatch(run) or NAME.fullmatch(run):
        return False
    if INTEGRITY.fullmatch(run) or len(run) in DIGESTS and HEX.fullmatch(run.lower()):
        return False
    return efficiency(run) <= RATIO


class Stretches:
    """Whether a stretch of a run is a secret by the tokens of the whole run, in a time that doesn't depend on its length."""

    def __init__(self, run: str, stops: list[int]):
        self.run, self.stops = run, stops

    def dense(self, start: int, end: int) -> bool:
        """Characters for each token that the stretch has a part of are ``RATIO`` at most, and it is long enough and no digest or UUID."""
        if end - start < LEAST:
            return False
        if end - start <= max(DIGESTS):
            text = self.run[start:end]
            if UUID.fullmatch(text) or INTEGRITY.fullmatch(text) or end - start in DIGESTS and HEX.fullmatch(text.lower()):
                return False
        return end - start <= RATIO * (bisect_left(self.stops, end) - bisect_right(self.stops, start) + 1)

    def without_first_words(self, start: int, end: int) -> int:
        """Where the stretch begins once its first words are gone, one by one as long as the rest is a secret."""
        letter = next((k for k in range(end - 1, start - 1, -1) if self.run[k] in _LETTERS), -1)
        bad = -1  # as long as the rest begins no later, what is here makes it no name
        while m := _WORD_FIRST.match(self.run, start, end):
            at = m.end()
            if at > bad:
                name = NAME.match(self.run, at, end)
                bad = name.end() if name else at
                if bad == end and name:
                    break
            if letter < at or not self.dense(at, end):
                break
            start = at
        return start

    def without_last_words(self, start: int, end: int) -> int:
        """Where it ends once its last words are gone, one by one as long as the rest is a secret."""
        letter = next((k for k in range(start, end) if self.run[k] in _LETTERS), end)
        name = NAME.match(self.run, start, end)
        while True:
            word = end
            while word > start and self.run[word - 1] in _LETTERS:
                word -= 1
            at = word
            while at > start and self.run[at - 1] in _SEPARATORS:
                at -= 1
            if at == word or not _WORD.fullmatch(self.run, word, end):
                return end
            if name and at <= name.end() or letter >= at or not self.dense(start, at):
                return end
            end = at


def inner_spans(run: str, efficiency: Efficiency) -> list[tuple[int, int]]:
    """Stretches of tokens of a run that are secrets, without plain words at their ends."""
    taken = [m.span() for m in _UUID_IN.finditer(run)]
    taken += [m.span() for m in _HEX_IN.finditer(run) if m.end() - m.start() in DIGESTS]
    taken += [m.span() for m in INTEGRITY.finditer(run)]
    taken.sort()
    taken_ends = [b for _, b in taken]
    stops = [0]
    for size in efficiency.sizes(run):
        stops.append(stops[-1] + size)
    stretches = Stretches(run, stops)
    pieces = [m.span() for m in _PIECE.finditer(run)]
    starts, ends = [a for a, _ in pieces], [b for _, b in pieces]
    found = [(a, b) for a, b in pieces if is_secret(run[a:b], efficiency)]
    to = 0
    for at, start in enumerate(stops):
        while to < len(stops) and stops[to] - start < LEAST:
            to += 1
        if to == len(stops):
            break
        end = stops[to]
        if end - start <= RATIO * (to - at) and _LETTER.search(run, start, end) and not NAME.fullmatch(run, start, end):
            found.append((start, end))
    joined: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if (k := bisect_right(taken_ends, start)) < len(taken) and taken[k][0] < end:
            continue
        if joined and start < joined[-1][1]:
            joined[-1] = joined[-1][0], max(end, joined[-1][1])
        else:
            joined.append((start, end))
    out: list[tuple[int, int]] = []
    for start, end in joined:
        first, last = bisect_right(ends, start), bisect_left(starts, end) - 1
        wide = min(start, starts[first]), max(end, ends[last])
        start, end = wide if is_secret(run[slice(*wide)], efficiency) else (start, end)
        start = stretches.without_first_words(start, end)
        end = stretches.without_last_words(start, end)
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def token_spans(text: str, efficiency: Efficiency) -> list[tuple[int, int, int]]:
    out = []
    for m in RUN.finditer(text):
        run = m.group()
        if UUID.fullmatch(run) or NAME.fullmatch(run) or INTEGRITY.fullmatch(run) or len(run) in DIGESTS and HEX.fullmatch(run.lower()):
            continue
        if is_secret(run, efficiency):
            out.append((m.start(), 3, m.end()))
        else:
            out += [(m.start() + a, 3, m.start() + b) for a, b in inner_spans(run, efficiency)]
    return out


_made: dict[tuple[str, str], Efficiency] = {}


def _efficiency(path: str, pattern: str) -> Efficiency:
    if (path, pattern) not in _made:
        _made[path, pattern] = Efficiency(path, pattern)
        keep("secrets", _made.clear)
    return _made[path, pattern]


def find_secrets(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and secrets array<struct<kind, start, end>> (code points, end exclusive).

    Spans are ordered by start, then kind as in ``KINDS``; kinds may overlap.  Null and empty texts
    have none.  Rows that repeat give a row each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        efficiency = _efficiency(path, pattern)
        for batch in batches:
            found = []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = sorted(base_spans(text) + token_spans(text, efficiency))
                found.append([{"kind": KINDS[k], "start": b, "end": e} for b, k, e in spans])
            spans = pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=[id_col, "secrets"])

    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    span = T.StructType().add("kind", "string").add("start", "long").add("end", "long")
    schema = docs.select(quoted(id_col)).schema.add("secrets", T.ArrayType(span))
    return chosen.mapInArrow(batches_of("secrets", run), schema)


def redact(text: str, spans: list[tuple[int, int]], mark: str = "<secret>") -> str:
    """``text`` with the union of the spans replaced by ``mark``."""
    out, last = [], 0
    for start, end in sorted(spans):
        if start >= last:
            out += [text[last:start], mark]
        last = max(last, end)
    return "".join([*out, text[last:]])


def span_digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
