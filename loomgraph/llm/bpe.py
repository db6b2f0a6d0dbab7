"""Byte-level BPE encoding and decoding, merges driven by a hierarchical-bitmap rank queue.

One queue serves many matches of the pattern at a time, or one very long one.  Their
bytes lie end to end in a linked list of tokens whose links never cross from one match
into the next.  Each adjacent pair that has a merge rank enters the bucket of that rank.
Two levels of bitmaps mark the buckets in use; find-first-set on the summary, then on
the word below it, gives the lowest rank.  A bucket holds list positions; it is sorted
when its turn comes, so that the leftmost pair merges first.  An entry whose pair has
changed since is stale and skipped, and a bucket is put back when a merge brings up a
lower rank.  Large buckets are merged by numpy, but for entries that touch each other.  Each merge adds at most two entries, so matches of n bytes together take
O(n log n) steps, also if one of them is megabytes long.

Results are those of greedy lowest-rank merging: each match of the pattern by
itself, whole matches in the vocabulary taken as they are, no special tokens.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import unicodedata
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.common import arrow_map, table

#: Matches of up to so many characters are remembered, by default in two generations of so many.
_CACHED_CHARS, _CACHED_WORDS = 48, 200_000
#: Texts are taken together up to so many characters, a longer one in runs of so many matches; matches are merged together up to so many bytes.
_GROUP_CHARS, _RUN_WORDS, _RUN_BYTES = 1 << 22, 500_000, 1 << 19
#: A bucket of so many entries or more is merged by numpy.
_MANY = 24
#: Code points below this one take the faster expression.
_LATIN = 0x250


def latin_pattern(pattern: str) -> re.Pattern | None:
    r"""The pattern for the standard library, with ``\p{L}`` and ``\p{N}`` spelt out below _LATIN; None if it has other such classes or they would differ there.

    It holds for texts in which ``beyond`` finds nothing: the two libraries differ about U+001C to U+001F as white space.
    """
    import regex

    spelt, inside, at = [], False, 0
    while at < len(pattern):
        found = re.compile(r"\\p\{([LN])\}").match(pattern, at)
        if found:
            mine = [i for i in range(_LATIN) if unicodedata.category(chr(i))[0] == found[1]]
            if mine != [i for i in range(_LATIN) if regex.match(found[0], chr(i))]:
                return None
            own = "".join(f"\\u{i:04x}" for i in mine)
            spelt.append(own if inside else f"[{own}]")
            at = found.end()
            continue
        step = 2 if pattern[at] == "\\" else 1
        inside = pattern[at] == "[" or (inside and pattern[at] != "]")
        spelt.append(pattern[at : at + step])
        at += step
    try:
        out = re.compile("".join(spelt))
    except re.error:
        return None
    same = all(bool(re.match(r"\s", c)) == bool(regex.match(r"\s", c)) for c in map(chr, range(_LATIN)) if not "\x1c" <= c <= "\x1f")
    return out if same else None


beyond = re.compile("[^\x00-\x1b\x20-\u024f]").search


class _Packed(dict):
    """The ids of remembered matches; it takes over what is asked for of the generation before, and notes what is in neither."""

    def __init__(self, older: dict[str, bytes]) -> None:
        self.older, self.new = older, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            self.new[word] = None
            return b""
        self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str, pattern: str, remember: int = _CACHED_WORDS) -> None:
        import regex

        self.remember = remember
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.latin = regex.compile(pattern), latin_pattern(pattern)
        self.decimal = {piece: b"%d" % rank for piece, rank in self.ranks.items()}
        self.piece = {d: piece for piece, d in self.decimal.items()}
        self.words = [0] * (max(self.ranks.values()) // 64 + 1)  # the lower bitmap: a bit for each rank; empty between calls
        self.top = max(self.ranks.values()) + 1
        self.decimals = [b"%d" % rank for rank in range(self.top)]
        self.bytes_ = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = np.full(1 << 16, -1, np.int32)  # the ranks of two bytes
        known = {}  # of two tokens, by left * top + right
        for piece, rank in self.ranks.items():
            if len(piece) == 2:
                self.pairs[piece[0] << 8 | piece[1]] = rank
            for at in range(1, len(piece)):
                left, right = self.ranks.get(piece[:at]), self.ranks.get(piece[at:])
                if left is not None and right is not None:
                    known[left * self.top + right] = rank
        self.keys = np.array(sorted(known), np.int64)
        self.values = np.array([known[k] for k in self.keys.tolist()], np.int32)
        self.forget()

    def forget(self) -> None:
        """Drops the remembered matches."""
        self.packed = _Packed({})

    def _look(self, left: np.ndarray | int, right: np.ndarray | int) -> np.ndarray:
        """The ranks of pairs of tokens, -1: none."""
        key = left * self.top + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], -1)

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, a whole match by itself, as decimals with a blank between."""
        data, n = b"".join(pieces), sum(map(len, pieces))
        if not n:
            return [b""] * len(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        # The linked list, for the loop as arrays and for numpy as views of them.
        stop, before, pair, token, edge = (array("i", bytes(4 * (n + 1))) for _ in range(5))
        stops, befores, ranks, tokens, edges = (np.frombuffer(x, np.int32) for x in (stop, before, pair, token, edge))
        stops[:] = np.arange(1, n + 2)  # where the token that begins here ends
        befores[:] = np.arange(-1, n)  # where the token before it begins
        two = np.frombuffer(data, np.uint8).astype(np.int32)
        tokens[:n] = self.bytes_[two]
        ranks[:] = -1  # the rank of this token and the next, -1: none
        ranks[: n - 1] = self.pairs[two[:-1] << 8 | two[1:]]
        ranks[ends[ends > 0] - 1] = -1
        edges[0] = 1  # where a piece begins or ends
        edges[ends] = 1
        words, summary = self.words, 0  # summary: a bit for each word of the lower bitmap that is in use
        buckets: dict[int, list[int]] = {}

        def push(places: np.ndarray, new: np.ndarray) -> None:
            nonlocal summary
            order = np.argsort(new, kind="stable")
            places, new = places[order].tolist(), new[order]
            cuts = [0, *(np.flatnonzero(np.diff(new)) + 1).tolist(), len(new)]
            for r, a, b in zip(new[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if r in buckets:
                    buckets[r] += places[a:b]
                else:
                    buckets[r] = places[a:b]
                    words[r >> 6] |= 1 << (r & 63)
                    summary |= 1 << (r >> 6)

        places = np.flatnonzero(ranks >= 0)
        if len(places):
            push(places, ranks[places])
        del two, places
        of = self.ranks.get
        while summary:
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            rank = (w << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets.pop(rank)
            bits &= bits - 1
            words[w] = bits
            if not bits:
                summary &= summary - 1
            bucket.sort()
            if len(bucket) >= _MANY:
                # Those that touch no other of the bucket at once, if none of them brings up a lower rank.
                own = np.array(bucket, np.int32)
                own = own[ranks[own] == rank]
                middle = stops[own]
                end = stops[middle]
                touch = np.zeros(len(own), bool)
                near = end[:-1] >= own[1:]
                touch[:-1] = near
                touch[1:] |= near
                free = ~touch
                bucket = own[touch].tolist()
                own, middle, end = own[free], middle[free], end[free]
                if len(own):
                    right, left = edges[end] == 0, edges[own] == 0
                    r_at, r_end, l_at = own[right], end[right], befores[own[left]]
                    r_new, l_new = self._look(rank, tokens[r_end].astype(np.int64)), self._look(tokens[l_at].astype(np.int64), rank)
                    new = np.concatenate((r_new, l_new))
                    if ((new >= 0) & (new < rank)).any():
                        bucket = sorted(bucket + own.tolist())
                    else:
                        ranks[middle] = -1
                        ranks[own] = -1
                        stops[own] = end
                        tokens[own] = rank
                        befores[r_end] = r_at
                        ranks[r_at] = r_new
                        ranks[l_at] = l_new
                        good = new >= 0
                        if good.any():
                            push(np.concatenate((r_at, l_at))[good], new[good])
            lower = False
            for done, i in enumerate(bucket, 1):
                if pair[i] != rank:
                    continue
                middle = stop[i]
                end = stop[middle]
                pair[middle] = -1
                stop[i] = end
                token[i] = rank
                if edge[end]:
                    pair[i] = -1
                else:
                    before[end] = i
                    pair[i] = r = of(data[i : stop[end]], -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            words[r >> 6] |= 1 << (r & 63)
                            summary |= 1 << (r >> 6)
                        lower |= r < rank
                if not edge[i]:
                    j = before[i]
                    pair[j] = r = of(data[j:end], -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(j)
                        else:
                            buckets[r] = [j]
                            words[r >> 6] |= 1 << (r & 63)
                            summary |= 1 << (r >> 6)
                        lower |= r < rank
                if lower:
                    if done < len(bucket):
                        buckets[rank] = bucket[done:]
                        words[w] |= 1 << (rank & 63)
                        summary |= 1 << w
                    break
        # The tokens that are left, from the beginning of each piece on.
        at, starts = 0, array("i")
        while at < n:
            starts.append(at)
            at = stop[at]
        starts = np.frombuffer(starts, np.int32)
        listed = list(map(self.decimals.__getitem__, tokens[starts].tolist()))
        cuts = [0, *np.searchsorted(starts, ends).tolist()]
        return [b" ".join(listed[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct matches."""
        found, pieces, kept, size = {}, [], [], 0
        whole = self.decimal.get
        for word in words:
            piece = word.encode("utf-8", "surrogatepass")
            ids = whole(piece)
            if ids is not None:
                found[word] = ids
                continue
            pieces.append(piece)
            kept.append(word)
            size += len(piece)
            if size >= _RUN_BYTES:
                found.update(zip(kept, self.merged(pieces), strict=True))
                pieces, kept, size = [], [], 0
        if pieces:
            found.update(zip(kept, self.merged(pieces), strict=True))
        return found

    def _together(self, runs: list[list[str]]) -> list[bytes]:
        """The ids of each run of matches."""
        if len(self.packed) >= self.remember:
            self.packed = _Packed(dict(self.packed))
        packed = self.packed
        for words in runs:
            deque(map(packed.__getitem__, words), 0)
        learnt = self._learn(list(packed.new))
        packed.new.clear()
        packed.update(learnt)
        out = [b" ".join(map(packed.__getitem__, words)) for words in runs]
        for w in learnt:
            if len(w) > _CACHED_CHARS:
                del packed[w]
        return out

    def id_texts(self, texts: Iterable[str]) -> Iterator[bytes]:
        """For each text its ids as decimals with a blank between."""
        runs, size = [], 0
        for text in texts:
            found = self.latin if self.latin and not beyond(text) else self.pattern
            if len(text) < _GROUP_CHARS:
                runs.append(found.findall(text))
                size += len(text)
                if size < _GROUP_CHARS:
                    continue
            yield from self._together(runs)
            runs, size = [], 0
            if len(text) >= _GROUP_CHARS:
                matches = (m[0] for m in found.finditer(text))
                yield b" ".join([self._together([run])[0] for run in iter(lambda: list(islice(matches, _RUN_WORDS)), [])])
        yield from self._together(runs)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, as unsigned 32-bit numbers."""
        return numbers(next(self.id_texts([text])))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, given as decimals with a blank between."""
        return b"".join(map(self.piece.__getitem__, ids.split(b" "))) if ids else b""


def numbers(ids: bytes) -> np.ndarray:
    return np.array(ids.split(b" "), np.uint32) if ids else np.zeros(0, np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str, remember: int = _CACHED_WORDS) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path, pattern, remember)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, remember: int = _CACHED_WORDS, forget: bool = False) -> DataFrame:
    """Encodes every text and decodes its ids again, one row for each row of docs; nothing is shuffled.

    Returns id_col, n_tokens long, ids_sha256, decoded_sha256, and with with_ids
    also ids (little-endian unsigned 32-bit numbers).  A worker remembers up to
    2 * remember short matches; with forget it drops them after each partition, so
    that it holds none while it does other work.  The rows are the same.  A null text counts as empty:
    no tokens, the hash of no bytes.  A very long text is matched in runs, so beside
    itself and its ids only a run is held; a single match of n bytes takes about 60 n.
    Null ids, repeated rows and other columns do not matter; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern, remember)
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                n, hashes, back, packed = [], [], [], []
                for ids in own.id_texts(text.as_py() or "" for text in batch.column(1)):
                    n.append(ids.count(b" ") + 1 if ids else 0)
                    hashes.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(own.decode(ids)).hexdigest())
                    if with_ids:
                        packed.append(numbers(ids).astype("<u4").tobytes())
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(packed, pa.binary())] * with_ids, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)
        if forget:
            own.forget()

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return arrow_map(docs.select(id_col, text_col), run, schema)


def vocabulary() -> tuple[str, str]:
    """(path, pattern) of the production vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), *vocabulary())
