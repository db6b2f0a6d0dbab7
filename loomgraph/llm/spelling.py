r"""Spelling variants of a corpus's words: near words by two-dimensional range reporting.

Two words are near if one inserted, deleted or replaced code point makes one of the
other.  If the edit is at position i, they share what is before it and what is after it.
In forward order the words of a length that begin with a prefix are an interval, and in
reverse order (words read backwards) those that end with a suffix.  A word is a point:
its places in the two orders.  So for each edit position the words wanted are the points
in a rectangle, prefix interval by suffix interval, and a wavelet tree over one order's
sequence of the other order's places reports them one by one.

No tree covers all words.  Either order is cut into blocks of ``block`` words, each with
a wavelet tree of its own.  An edit in the second half of a word leaves its first half as
it is, so it is looked for in forward blocks, where that half's interval lies in few; an
edit in the first half is looked for in reverse blocks.  Words that share a half with very
many others ask all blocks that hold them, and a block that very many ask is answered by
several tasks.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import arrow_map, dropped, stored, table
from loomgraph.operators.ordering import numbered

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO, NOISE = 6, 5, 5, 199
BLOCK, ASKED = 8192, 32768
#: After every word that begins as the string before it.
_LAST = "\U0010ffff"


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, noise: int | None = None, letters: str = LETTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the maximal runs of letters of whole texts, A-Z lower-cased, of at least min_length code points.

    With noise, a run w of document d loses its code point h % length if noise
    divides h, the CRC-32 of "d:w" (a null id as nothing): planted misspellings.
    Each task first counts by itself, so a word that fills the corpus is a few
    rows.  Null and empty texts have no words; repeated rows count each.
    """
    # Of whole runs only: none begins within a run that was too short.
    runs = re.compile(f"[{letters}]{{{min_length},}}")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 1000):
                part, found = batch.slice(first, 1000), Counter()
                for name, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if not text.is_valid:
                        continue
                    own = Counter(runs.findall(text.as_py().encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                    if noise:
                        start = zlib.crc32(("" if name is None else f"{name}").encode() + b":")
                        for w, n in list(own.items()):
                            h = zlib.crc32(w.encode("utf-8", "surrogatepass"), start)
                            if h % noise == 0:
                                del own[w]
                                at = h % len(w)
                                less = w[:at] + w[at + 1 :]
                                if len(less) >= min_length:
                                    found[less] += n
                    found.update(own)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    counts = arrow_map(docs.select(id_col, text_col), go, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """A wavelet tree over a permutation, level by level as bit vectors with rank sums."""

    def __init__(self, sequence: np.ndarray) -> None:
        self.n, self.levels = len(sequence), max(1, int(len(sequence) - 1).bit_length())
        self.zeros, self.split = [], []
        for k in range(self.levels - 1, -1, -1):
            bits = (sequence >> k) & 1
            before = np.zeros(self.n + 1, np.int64)
            np.cumsum(1 - bits, out=before[1:])
            self.zeros.append(before)
            self.split.append(int(before[-1]))
            sequence = np.concatenate((sequence[bits == 0], sequence[bits == 1]))

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [low, high) at positions [left, right), for all queries at once; only nodes that overlap a query's values are entered."""
        query = np.flatnonzero((left < right) & (low < high))
        left, right, value = left[query], right[query], np.zeros(len(query), np.int64)
        for k, zeros, split in zip(range(self.levels - 1, -1, -1), self.zeros, self.split, strict=True):
            a, b = zeros[left], zeros[right]
            query = np.concatenate((query, query))
            left, right = np.concatenate((a, split + left - a)), np.concatenate((b, split + right - b))
            value = np.concatenate((value, value + (1 << k)))
            on = (left < right) & (value < high[query]) & (value + (1 << k) > low[query])
            query, left, right, value = query[on], left[on], right[on], value[on]
        return query, value


def _key(size: int, word: str) -> str:
    return f"{size:010d}{word}"


def _within(keys: list[str], key: str, low: int, high: int) -> tuple[int, int]:
    """The interval of the keys that begin with key, within [low, high)."""
    a = bisect_left(keys, key, low, high)
    return a, bisect_left(keys, key + _LAST, a, high)


def near_pairs(members: list[tuple[str, int]], asked: list[tuple[str, int]], reverse: bool) -> tuple[list[int], list[int], list[bool]]:
    """(places in asked, places in members, whether an inserted code point makes the member) of near words, each pair once.

    In forward order these are the edits in the second half of the word asked
    for, in reverse order those in its first half.
    """
    turn = (lambda w: w[::-1]) if reverse else (lambda w: w)
    own = sorted(range(len(members)), key=lambda i: _key(len(members[i][0]), turn(members[i][0])))
    other = sorted(range(len(members)), key=lambda i: _key(len(members[i][0]), turn(members[i][0])[::-1]))
    keys = [_key(len(members[i][0]), turn(members[i][0])) for i in own]
    back = [_key(len(members[i][0]), turn(members[i][0])[::-1]) for i in other]
    place = np.empty(len(own), np.int64)
    place[np.array(other)] = np.arange(len(own))
    tree = WaveletTree(place[np.array(own)])
    rects: list[tuple[int, int, int, int]] = []
    tags: list[tuple[int, int, bool]] = []
    for q, (w, _) in enumerate(asked):
        u, n, half = turn(w), len(w), len(w) // 2
        for grown in (False, True):
            size, begin = n + grown, n - half + grown if reverse else half
            a, b = _within(keys, _key(size, u[:begin]), 0, len(keys))
            for j in range(begin, size):
                if j > begin:
                    a, b = _within(keys, _key(size, u[:j]), a, b)
                if a == b or not grown and b == a + 1 and members[own[a]][0] == w:
                    break  # nothing, or the word alone, begins so
                c, d = _within(back, _key(size, u[j if grown else j + 1 :][::-1]), 0, len(back))
                if c < d:
                    rects.append((a, b, c, d))
                    tags.append((q, n - j if reverse and grown else n - 1 - j if reverse else j, grown))
    if not rects:
        return [], [], []
    found = ([], [], [])
    for r, y in zip(*(x.tolist() for x in tree.report(*np.array(rects, np.int64).T)), strict=True):
        q, i, grown = tags[r]
        w, m = asked[q][0], other[y]
        x = members[m][0]
        # A code point inserted beside its like makes the same word at several places; the first counts.
        if x != w and not (grown and i and w[i - 1] == x[i]):
            for column, v in zip(found, (q, m, grown), strict=True):
                column.append(v)
    return found


def _search(group: pa.Table) -> pa.Table:
    reverse = group.column("reverse")[0].as_py()
    rows = list(zip(group.column("word").to_pylist(), group.column("n").to_pylist(), strict=True))
    member = group.column("member").to_pylist()
    members, asked = [r for r, m in zip(rows, member, strict=True) if m], [r for r, m in zip(rows, member, strict=True) if not m]
    out: list[tuple[str, int, str, int]] = []
    for q, m, grown in zip(*near_pairs(members, asked, reverse), strict=True):
        out.append((*asked[q], *members[m]))
        if grown:
            out.append((*members[m], *asked[q]))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    return pa.table({"word": pa.array(columns[0], pa.string()), "n": pa.array(columns[1], pa.int64()), "near": pa.array(columns[2], pa.string()), "near_n": pa.array(columns[3], pa.int64())})


def near_words(words: DataFrame, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """(word, n, near, near_n), a row for each ordered pair of near words of words (word, n; words distinct, of two code points at least).

    A word has as many near words as there are letters times places at most.
    The driver gathers the first and last word of each block, a row for every
    ``block`` words; a task holds ``block`` words and about ``asked`` that ask.
    """
    words = stored(words.select("word", "n"))
    blocks, bounds = [], {}
    for reverse in (False, True):
        key = F.concat(F.lpad(F.length("word").cast("string"), 10, "0"), F.reverse("word") if reverse else F.col("word"))
        own = numbered(words.withColumn("key", key), [F.col("key")], "place", stored)
        own = stored(own.select(F.lit(reverse).alias("reverse"), F.floor(F.col("place") / block).alias("block"), "key", "word", "n"))
        blocks.append(own.select("reverse", "block", "word", "n"))
        bounds[reverse] = sorted(own.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last")).select("first", "last", "block").collect())
    edges = {reverse: ([x["first"] for x in xs], [x["last"] for x in xs], [x["block"] for x in xs]) for reverse, xs in bounds.items()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, reverses, to = [], [], []
            for i, w in enumerate(batch.column(0).to_pylist()):
                half = len(w) // 2
                for reverse, fixed in ((False, w[:half]), (True, w[half:][::-1])):
                    firsts, lasts, numbers = edges[reverse]
                    wanted = set()
                    for size in (len(w), len(w) + 1):
                        low = _key(size, fixed)
                        for k in range(max(0, bisect_right(firsts, low) - 1), bisect_left(firsts, low + _LAST)):
                            if lasts[k] >= low:
                                wanted.add(numbers[k])
                    of += [i] * len(wanted)
                    reverses += [reverse] * len(wanted)
                    to += wanted
            of = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(reverses, pa.bool_()), pa.array(to, pa.int64()), batch.column(0).take(of), batch.column(1).take(of)], ["reverse", "block", "word", "n"])

    ask = stored(words.repartition("word").mapInArrow(route, "reverse boolean, block long, word string, n long"))
    parts = stored(ask.groupBy("reverse", "block").agg(F.ceil(F.count(F.lit(1)) / asked).cast("int").alias("parts")))
    ask = ask.join(parts, ["reverse", "block"]).select("reverse", "block", F.pmod(F.xxhash64("word"), "parts").cast("int").alias("part"), "word", "n", F.lit(False).alias("member"))
    members = blocks[0].unionByName(blocks[1]).join(parts, ["reverse", "block"])
    members = members.select("reverse", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "word", "n", F.lit(True).alias("member"))
    return ask.unionByName(members).groupBy("reverse", "block", "part").applyInArrow(_search, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) without circles: root is what following forms ends at. Each round doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("on"))
        step = stored(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        dropped(now)
        now = step
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def grouped(words: DataFrame, ratio: int = RATIO, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n).

    form is the near word of largest n, of equals the first in code-point order,
    if that n is at least ratio (2 or more) times the word's own; else null, as is
    form_n.  root is what following forms from the word ends at, the word itself
    without a form.  n grows by ratio with every step, so there are no circles.

    words must be distinct and not null; an empty table gives no rows.  Words of
    any length are compared whole.
    """
    words = stored(words.select("word", "n"))
    near = near_words(words, block, asked)
    best = near.groupBy("word").agg(F.first("n").alias("own"), F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    holds = -F.col("best.less") >= ratio * F.col("own")
    best = stored(best.select("word", "n_near", F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n")))
    ends = roots(best.where("form is not null"))
    out = words.join(best, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least 6 code points that occur 5 times, with the misspellings planted."""
    return grouped(word_counts(table(spark, sf_dir, "documents"), noise=NOISE).where(F.col("n") >= MIN_COUNT))
