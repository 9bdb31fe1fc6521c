"""Line dedup by an exact set-similarity join.

A line is its set of words. A line that matches an earlier one (by document id, then line
number) with a Jaccard similarity of at least the threshold is removed, whether or not that
earlier line stays itself; so the outcome does not depend on any order of work.

Lines with equal sets are one class, placed where the first of them stands; tasks drop their
own repeats before anything is shuffled. Words are ordered by rarity, counted over the whole
corpus in a table of fixed size; any order gives the right result, a good one gives few
candidates. Two sets that match share a word among the first few of each (prefix filter). At
any word that they share there, its places bound what they can share in all (positional
filter), which is never more than their sizes (length filter), and parities of each set, 64
or for longer ones 128, bound how much they differ. What passes is verified on the words themselves.

What moves between tasks are packed arrays, one row for many lines or postings. A part of the
words meets in one task. The classes of a word are compared pair by pair, but only the
likeliest few candidates of each class leave the task. Where a class has more, the word's
postings are kept, and those of words with very many classes are kept in blocks. Once the
first candidates are verified, classes that are still without a match, and no others, are
compared with all that was kept, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Kept, begin, bitmap, cut, fresh, mark, quoted, release, slices, slot
from weftline.llm.shingles import BLOCK, mixed, word_hashes

#: Similarity of a match, in per cent.
PERCENT = 80
#: Counters of word frequency, a power of two.
COUNTERS = 1 << 20
#: Bits of the filters that tell which texts and lines are needed, and which classes are open.
FILTER_BITS = 1 << 24
#: Parts for each shuffle partition: a task holds one part at a time.
PARTS = 2
#: Sets of so many words have 128 parities; of fewer, 64 tell sets apart.
WIDE = 80
#: Classes of a word that are compared at once; more are kept in blocks of so many.
SMALL = 1024
#: Candidates of a class that leave the task for each of its words, and classes of a larger
#: word that the others are compared with at first.
EACH, HEADS = 8, 32
#: Lines, or postings, that a task gathers before it packs or sorts them.
GATHER, HOLD = 1 << 18, 1 << 20
#: Pairs that are put to the filters at once.
PAIRS = 1 << 18

AT = np.dtype([("doc", "<i8"), ("line", "<i4")])
LINE = np.dtype([("c1", "<u8"), ("c2", "<u8"), ("doc", "<i8"), ("line", "<i4"), ("n", "<i4"), ("parity", "<u8"), ("half", "<u8")])
POST = np.dtype([("word", "<u4"), ("n", "<i4"), ("place", "<i4"), ("line", "<i4"), ("doc", "<i8"), ("parity", "<u8"), ("half", "<u8")])


def packed(a: np.ndarray) -> bytes:
    """Records column after column, which compresses better than row after row."""
    return b"".join(np.ascontiguousarray(a[name]).tobytes() for name in a.dtype.names)


def unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    out, at = np.empty(len(data) // kind.itemsize, kind), 0
    for name in kind.names:
        out[name] = np.frombuffer(data, kind[name], len(out), at)
        at += len(out) * kind[name].itemsize
    return out


def _lines(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Blocks of lines: index of each line's text, its number in the text, its bytes."""
    of, no, block, held = [], [], [], 0
    for i, t in enumerate(texts):
        lines = (t or "").encode("utf-8", "replace").lower().split(b"\n")
        of += [i] * len(lines)
        no += range(len(lines))
        block += lines
        held += sum(map(len, lines))
        if held > BLOCK:
            yield np.array(of), np.array(no), block
            of, no, block, held = [], [], [], 0
    if block:
        yield np.array(of), np.array(no), block


def _counter(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def word_counts(df: DataFrame, text_col: str) -> np.ndarray:
    """How often the words of each counter occur in the corpus."""
    chunk = 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        seen = np.zeros(COUNTERS, np.int64)
        for b in slices(batches):
            for _, _, block in _lines(b.column(0).to_pylist()):
                seen += np.bincount(_counter(word_hashes(block)[0]), minlength=COUNTERS)
        for i in range(0, COUNTERS, chunk):
            at = np.flatnonzero(seen[i : i + chunk])
            if len(at):
                yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "at": [at.astype("<u2").tobytes()], "n": [seen[i + at].tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            for i, at, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                seen.setdefault(i, np.zeros(chunk, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, np.int64)
        for i, n in seen.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "n": [n.tobytes()]})

    parts = df.select(F.col(quoted(text_col)).alias("text")).mapInArrow(run, "part int, at binary, n binary")
    out = np.zeros(COUNTERS, np.int64)
    # COUNTERS numbers in all, whatever the corpus
    for i, n in parts.repartition("part").mapInArrow(add, "part int, n binary").collect():
        out[i : i + chunk] = np.frombuffer(n, np.int64)
    return out


def ordered_sets(block: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each line, rarest first, one line after the other; and their numbers."""
    words, n = word_hashes(block)
    line = np.repeat(np.arange(len(n)), n)
    rarity = np.minimum(counts[_counter(words)], (1 << 20) - 1).astype(np.uint64)
    if len(n) < 1 << 20:
        # one sort of what matters most; words that it leaves tied are the rare exception
        key = line.astype(np.uint64) << np.uint64(44) | rarity << np.uint64(24) | words >> np.uint64(40)
        at = np.argsort(key)
        key, sorted_words = key[at], words[at]
        if ((key[1:] == key[:-1]) & (sorted_words[1:] != sorted_words[:-1])).any():
            at = np.lexsort((words, rarity, line))
    else:
        at = np.lexsort((words, rarity, line))
    words, line = words[at], line[at]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
    return words[new], np.bincount(line[new], minlength=len(n))


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])
    ends = np.cumsum(n)
    return run[ends] - run[ends - n]


def _class_keys(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each line's set."""
    return _sums(mixed(words), n), _sums(mixed(words ^ np.uint64(0x5851F42D4C957F2D)), n)


def _parities(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line 64 parities: how many of its words fall on a bit, odd or even.

    And, for longer lines, the same of the half of all words; both together are 128 parities.
    """
    out = np.zeros((2, len(n)), np.uint64)
    some = n > 0
    if some.any():
        bit, start = np.uint64(1) << (words & np.uint64(63)), (np.cumsum(n) - n)[some]
        out[0][some] = np.bitwise_xor.reduceat(bit, start)
        out[1][some] = np.bitwise_xor.reduceat(np.where(words & np.uint64(64), bit, np.uint64(0)), start)
        out[1][n < WIDE] = 0
    return out[0], out[1]


def _apart(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many parities lines differ, which is never more than the words that they do not share."""
    whole, half = a["parity"][i] ^ b["parity"][j], a["half"][i] ^ b["half"][j]
    half[(a["n"][i] < WIDE) | (b["n"][j] < WIDE)] = 0
    return (np.bitwise_count(whole ^ half) + np.bitwise_count(half)).astype(np.int32)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Two sets that match share one of so many first words."""
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def _firsts(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are the first of their class, and which others match those."""
    at = np.lexsort((lines["line"], lines["doc"], lines["c2"], lines["c1"]))
    s = lines[at]
    same = (s["c1"][1:] == s["c1"][:-1]) & (s["c2"][1:] == s["c2"][:-1])
    first = np.concatenate([[True], ~same])
    # a line that stands there twice, because its document does, matches nothing by that
    head = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    again = (s["doc"] == s["doc"][head]) & (s["line"] == s["line"][head])
    return at[first], at[~first & ~again]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start .. start + n - 1 of each, one after the other."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


ROW = "part int, at binary, more binary"


def _row(part: int, at: bytes, more: bytes | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.binary()), pa.array([more], pa.binary())], names=["part", "at", "more"])


def _at(rows: np.ndarray) -> bytes:
    out = np.empty(len(rows), AT)
    out["doc"], out["line"] = rows["doc"], rows["line"]
    return packed(out)


class _Classes:
    """Gathers lines with their prefixes; gives the first of each class, and the others."""

    def __init__(self) -> None:
        self.lines: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        self.held = 0

    def add(self, lines: np.ndarray, words: np.ndarray) -> None:
        self.lines.append(lines)
        self.words.append(words)
        self.held += len(lines)

    def take(self, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lines, start and length of their prefixes in the words; then lines that go."""
        lines, words = np.concatenate(self.lines), np.concatenate(self.words)
        self.__init__()
        n = prefix_size(lines["n"].astype(np.int64), percent)
        start = np.cumsum(n) - n
        first, gone = _firsts(lines)
        return lines[first], words[_ranges(start[first], n[first])], n[first], lines[gone]


def _classes(rows: DataFrame, counts: np.ndarray, percent: int, parts: int) -> DataFrame:
    """Packed lines by a part of their class; part -1 and below: lines that go."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        held, turn = _Classes(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            lines, words, n, gone = held.take(percent)
            if len(gone):
                yield _row(-1 - turn % parts, _at(gone))
                turn += 1
            part = (lines["c1"] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            start, ends = np.cumsum(n) - n, np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(ends)).tolist():
                some = order[ends[p] : ends[p + 1]]
                yield _row(p, packed(lines[some]), words[_ranges(start[some], n[some])].tobytes())

        for b in slices(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for of, no, block in _lines(b.column(1).to_pylist()):
                words, n = ordered_sets(block, shared.value)
                some = n > 0
                if not some.any():
                    continue
                lines = np.empty(int(some.sum()), LINE)
                c1, c2 = _class_keys(words, n)
                for name, got in (("c1", c1), ("c2", c2), ("doc", ids[of]), ("line", no), ("n", n), *zip(("parity", "half"), _parities(words, n), strict=True)):
                    lines[name] = got[some]
                start = np.cumsum(n) - n
                held.add(lines, (words[_ranges(start, prefix_size(n, percent))] >> np.uint64(32)).astype("<u4"))
                if held.held >= GATHER:
                    yield from flush()
        if held.held:
            yield from flush()

    return rows.mapInArrow(run, ROW)


def _postings(classes: DataFrame, percent: int, parts: int) -> DataFrame:
    """Packed postings of the first of each class, by a part of their word; lines that go pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        held, now, posts, n_posts, turn = _Classes(), None, [], 0, 0

        def deal() -> Iterator[pa.RecordBatch]:
            nonlocal n_posts
            p = np.concatenate(posts)
            posts.clear()
            n_posts = 0
            part = (p["word"].astype(np.uint64) * np.uint64(0x9E3779B1) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((p["word"], part))
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(ends)).tolist():
                yield _row(k, packed(p[order[ends[k] : ends[k + 1]]]))

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal n_posts, turn
            lines, words, n, gone = held.take(percent)
            if len(gone):
                yield _row(-1 - turn % parts, _at(gone))
                turn += 1
            p = np.empty(len(words), POST)
            of = np.repeat(np.arange(len(lines)), n)
            p["word"], p["place"] = words, _ranges(np.zeros(len(n), np.int64), n)
            for name in ("n", "line", "doc", "parity", "half"):
                p[name] = lines[name][of]
            posts.append(p)
            n_posts += len(p)
            if n_posts >= HOLD // 2:
                yield from deal()

        for b in batches:
            for part, at, more in zip(*(b.column(k) for k in range(3)), strict=True):
                part = part.as_py()
                if part < 0:
                    yield _row(part, at.as_py())
                    continue
                if part != now and held.held:
                    yield from finish()
                now = part
                held.add(unpacked(at.as_py(), LINE), np.frombuffer(more.as_py(), "<u4"))
        if held.held:
            yield from finish()
        if posts:
            yield from deal()

    return _by_part(classes).mapInArrow(run, ROW)


def _by_part(rows: DataFrame) -> DataFrame:
    return rows.repartition(_tasks(rows), "part").sortWithinPartitions("part")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _earlier(p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (p["doc"][i] < p["doc"][j]) | ((p["doc"][i] == p["doc"][j]) & (p["line"][i] < p["line"][j]))


def _pass(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of postings of one word the filters let through."""
    n = (a["n"][i] + b["n"][j]).astype(np.int64)
    good = (100 + percent) * np.minimum(a["n"][i] - a["place"][i], b["n"][j] - b["place"][j]).astype(np.int64) >= percent * n
    at = np.flatnonzero(good)
    good[at] = (100 + percent) * _apart(a, i[at], b, j[at]).astype(np.int64) <= (100 - percent) * n[at]
    return good


def _inside(p: np.ndarray, size: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (earlier, later) among postings in order of word and position.

    ``size`` tells how many postings each word has.
    """
    n = np.repeat(size, size)
    place = _ranges(np.zeros(len(size), np.int64), size)
    # posting k meets those of its word after it; so many pairs are met up to each posting
    after = n - 1 - place
    met = np.cumsum(after)
    at = 0
    while at < len(p):
        end = max(int(np.searchsorted(met, (met[at - 1] if at else 0) + PAIRS, "right")), at + 1)
        some = np.arange(at, end)
        i = np.repeat(some, after[at:end])
        j = i + 1 + _ranges(np.zeros(len(some), np.int64), after[at:end])
        good = _pass(p, i, p, j, percent)
        i, j = i[good], j[good]
        good = _earlier(p, i, j)
        yield i[good], j[good]
        at = end


OUT = "kind int, a_doc bigint, a_line int, doc bigint, line int, apart int, word bigint, blob binary, more binary"
PAIR, GONE, OPEN, LEFT = range(4)


def _out(kind: int, **cols) -> pa.RecordBatch:
    size = len(next(iter(cols.values())))
    kinds = {"kind": pa.int32(), "a_doc": pa.int64(), "a_line": pa.int32(), "doc": pa.int64(), "line": pa.int32(), "apart": pa.int32(), "word": pa.int64(), "blob": pa.binary(), "more": pa.binary()}
    cols["kind"] = np.full(size, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(size, t) for k, t in kinds.items()], names=list(kinds))


def _pair_rows(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    return _out(PAIR, a_doc=a["doc"][i], a_line=a["line"][i], doc=b["doc"][j], line=b["line"][j], apart=_apart(a, i, b, j))


def _best(i: np.ndarray, j: np.ndarray, apart: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are among the likeliest of their later side, and sides that have more."""
    order = np.lexsort((i, apart, j))
    new = np.concatenate([[True], j[order][1:] != j[order][:-1]])
    turn = np.arange(len(j)) - np.maximum.accumulate(np.where(new, np.arange(len(j)), 0))
    return order[turn < each], np.unique(j[order[turn >= each]])


class _Part:
    """One part's postings, as they come; words with very many go on in blocks."""

    def __init__(self, percent: int, small: int, each: int, heads: int):
        self.percent, self.small, self.each, self.n_heads = percent, small, each, heads
        self.blobs: list[np.ndarray] = []
        self.held, self.limit = 0, HOLD
        self.heads: dict[int, np.ndarray] = {}

    def add(self, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.blobs.append(p)
        self.held += len(p)
        if self.held >= self.limit:
            p, size = self._sorted()
            yield from self._large(p, size)
            few = np.repeat(size <= self.small, size)
            self.blobs, self.held = [p[few]], int(few.sum())
            # a part of nothing but small words has to be held
            self.limit = max(HOLD, 2 * self.held)

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        p = np.concatenate(self.blobs)
        p = p[np.lexsort((p["line"], p["doc"], p["word"]))]
        begin = np.flatnonzero(np.concatenate([[True], p["word"][1:] != p["word"][:-1]]))
        return p, np.diff(np.append(begin, len(p)))

    def end(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        p, size = self._sorted()
        # words that went on in blocks before do so to their end
        size_of = np.cumsum(size) - size
        known = np.array([int(w) in self.heads for w in p["word"][size_of].tolist()], bool) if self.heads else np.zeros(len(size), bool)
        yield from self._large(p, np.where(known, self.small + 1, size), size)
        few = (size <= self.small) & ~known
        yield from self._whole(p[np.repeat(few, size)], size[few])

    def _large(self, p: np.ndarray, judged: np.ndarray, size: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        size = judged if size is None else size
        start = np.cumsum(size) - size
        for k in np.flatnonzero(judged > self.small).tolist():
            word = p[start[k] : start[k] + size[k]]
            key = int(word["word"][0])
            heads = self.heads.setdefault(key, word[: self.n_heads].copy())
            for at in range(0, len(word), self.small):
                block = word[at : at + self.small]
                i, j = (x.ravel() for x in np.meshgrid(np.arange(len(heads)), np.arange(len(block)), indexing="ij"))
                good = _pass(heads, i, block, j, self.percent)
                i, j = i[good], j[good]
                both, j = np.concatenate([heads, block]), j + len(heads)
                for x, y in ((i, j), (j, i)):
                    ok = _earlier(both, x, y)
                    x, y = x[ok], y[ok]
                    if len(x):
                        some, _ = _best(x, y, _apart(both, x, both, y), self.each)
                        if len(some):
                            yield _pair_rows(both, x[some], both, y[some])
                yield _out(OPEN, doc=block["doc"], line=block["line"])
                yield _out(LEFT, word=[key], blob=[packed(block)], more=[np.ones(len(block), bool).tobytes()])

    def _whole(self, p: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Words all of whose postings are here, a bounded number of pairs at a time."""
        p, size = p[np.repeat(size > 1, size)], size[size > 1]
        pairs = np.cumsum(size * (size - 1) // 2)
        start, at = np.append(0, np.cumsum(size)), 0
        while at < len(size):
            end = max(int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, "right")), at + 1)
            some, few = p[start[at] : start[end]], size[at:end]
            at = end
            got = list(_inside(some, few, self.percent))
            i, j = (np.concatenate(x) for x in zip(*got, strict=True))
            if not len(i):
                continue
            best, more = _best(i, j, _apart(some, i, some, j), self.each)
            if len(best):
                yield _pair_rows(some, i[best], some, j[best])
            if len(more):
                flag = np.zeros(len(some), bool)
                flag[more] = True
                yield _out(OPEN, doc=some["doc"][more], line=some["line"][more])
                begin = np.cumsum(few) - few
                for k in np.flatnonzero(np.add.reduceat(flag, begin)).tolist():
                    word = slice(begin[k], begin[k] + few[k])
                    yield _out(LEFT, word=[int(some["word"][begin[k]])], blob=[packed(some[word])], more=[flag[word].tobytes()])


def _candidates(postings: DataFrame, percent: int, small: int, each: int, heads: int) -> DataFrame:
    """Candidate pairs, lines that go, classes with more candidates and the postings for those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        now, part = None, _Part(percent, small, each, heads)
        for b in batches:
            for key, at in zip(b.column(0), b.column(1), strict=True):
                key = key.as_py()
                if key < 0:
                    gone = unpacked(at.as_py(), AT)
                    yield _out(GONE, doc=gone["doc"], line=gone["line"])
                    continue
                if key != now:
                    yield from part.end()
                    now, part = key, _Part(percent, small, each, heads)
                yield from part.add(unpacked(at.as_py(), POST))
        yield from part.end()

    return _by_part(postings).mapInArrow(run, OUT)


def _slots(doc: np.ndarray, line: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(mixed(doc.astype(np.int64).view(np.uint64)) + line.astype(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _open_bits(open_: DataFrame, bits: int) -> np.ndarray:
    """A filter of the classes (doc, line), of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _slots(b.column(0).to_numpy(), b.column(1).to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at + 1)], names=["at"])

    out = np.zeros(bits, bool)
    for no, data in bitmap(open_.mapInArrow(run, "at bigint"), "at").collect():
        got = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: max(bits - (no - 1) * len(data) * 8, 0)]
        out[(no - 1) * len(data) * 8 :][: len(got)] = got
    return out


def _late_candidates(left: DataFrame, open_bits: np.ndarray, percent: int) -> DataFrame:
    """All candidates (a_doc, a_line, doc, line) of open classes among the postings kept."""
    shared = left.sparkSession.sparkContext.broadcast(np.packbits(open_bits))
    bits = len(open_bits)

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_open = np.unpackbits(shared.value)
        for b in batches:
            for word, blob, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = unpacked(blob, POST)
                p = p[np.frombuffer(more, bool) & (is_open[_slots(p["doc"], p["line"], bits)] > 0)]
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array([word], pa.int64()), pa.array([packed(p)], pa.binary())], names=["l_word", "late"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, more in zip(b.column(0), b.column(1), strict=True):
                early, p = unpacked(blob.as_py(), POST), unpacked(more.as_py(), POST)
                both = np.concatenate([early, p])
                step = max(PAIRS // len(early), 1)
                for at in range(0, len(p), step):
                    some = np.arange(at, min(at + step, len(p))) + len(early)
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(early)), some, indexing="ij"))
                    good = _pass(both, i, both, j, percent)
                    i, j = i[good], j[good]
                    good = _earlier(both, i, j)
                    if good.any():
                        rows = _pair_rows(both, i[good], both, j[good])
                        yield rows.select(["a_doc", "a_line", "doc", "line", "apart"])

    kept = left.select("word", "blob", "more")
    met = kept.select("word", "blob").join(kept.mapInArrow(late, "l_word bigint, late binary"), F.col("word") == F.col("l_word"))
    return met.select("blob", "late").mapInArrow(meet, "a_doc bigint, a_line int, doc bigint, line int, apart int")


def _line_texts(rows: DataFrame, needed: DataFrame, bits: int) -> DataFrame:
    """doc, line and text of the lines in ``needed`` (doc, line), and of a few others.

    One filter tells the documents that hold such lines, another the lines themselves.
    """
    docs = bitmap(needed.select(slot(bits, F.col("doc")).alias("at")), "at")
    lines = bitmap(needed.select(slot(bits, F.col("doc"), F.col("line")).alias("at")), "at")
    rows = mark(rows.toDF("doc", "text"), slot(bits, F.col("doc")), docs, "wanted").where("wanted")
    rows = rows.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return mark(rows, slot(bits, F.col("doc"), F.col("line")), lines, "wanted").where("wanted").select("doc", "line", "text")


def line_words(text: str) -> frozenset[bytes]:
    return frozenset(text.encode("utf-8", "replace").lower().split())


def matching(p: frozenset[bytes], q: frozenset[bytes], percent: int) -> bool:
    both = len(p & q)
    return 100 * both >= percent * (len(p) + len(q) - both)


def _matches(rows: DataFrame, pairs: DataFrame, percent: int, bits: int) -> DataFrame:
    """The later class (doc, line) of each pair whose words match; computed now.

    A document that stands there more than once with different texts matches with any of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([matching(line_words(x.as_py()), line_words(y.as_py()), percent) for x, y in zip(b.column(2), b.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["doc", "line"])

    needed = pairs.select("doc", "line").unionByName(pairs.select(F.col("a_doc").alias("doc"), F.col("a_line").alias("line")))
    texts = Kept(_line_texts(rows, needed, bits))
    early = texts.df.select(F.col("doc").alias("a_doc"), F.col("line").alias("a_line"), F.col("text").alias("a_text"))
    met = pairs.join(early, ["a_doc", "a_line"]).join(texts.df, ["doc", "line"])
    out = cut(met.select("doc", "line", "a_text", "text").mapInArrow(run, "doc bigint, line int").distinct())
    texts.drop()
    return out


def _verified(rows: DataFrame, pairs: DataFrame, percent: int, bits: int) -> DataFrame:
    """The later classes that match in one of the pairs: the likeliest pair of each is tried
    first, then the others of those that it does not match.
    """
    best = pairs.groupBy("doc", "line").agg(F.min(F.struct("apart", "a_doc", "a_line")).alias("b")).select("b.a_doc", "b.a_line", "doc", "line")
    got = _matches(rows, cut(best), percent, bits)
    others = cut(pairs.drop("apart").distinct().join(got, ["doc", "line"], "left_anti"))
    return got.unionByName(_matches(rows, others, percent, bits)) if others.limit(1).count() else got


def gone_lines(rows: DataFrame, counts: np.ndarray, percent: int = PERCENT, *, bits: int = FILTER_BITS, small: int = SMALL, each: int = EACH, heads: int = HEADS) -> tuple[DataFrame, Callable[[], None]]:
    """(doc, line) of the lines of ``rows`` (doc, text) that match an earlier one, once each.

    Also returns what deletes the files that the frame reads.
    """
    parts = PARTS * _tasks(rows)
    classes = _classes(rows, counts, percent, parts)
    met = Kept(_candidates(_postings(classes, percent, parts), percent, small, each, heads))
    release(rows.sparkSession)
    found = _verified(rows, met.df.where(F.col("kind") == PAIR).select("a_doc", "a_line", "doc", "line", "apart"), percent, bits)
    still = cut(met.df.where(F.col("kind") == OPEN).select("doc", "line").distinct().join(found, ["doc", "line"], "left_anti"))
    if still.limit(1).count():
        late = cut(_late_candidates(met.df.where(F.col("kind") == LEFT), _open_bits(still, bits), percent).distinct())
        found = found.unionByName(_verified(rows, late.join(found, ["doc", "line"], "left_anti"), percent, bits))
    release(rows.sparkSession)
    return met.df.where(F.col("kind") == GONE).select("doc", "line").unionByName(found).distinct(), met.drop


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = PERCENT, bits: int = FILTER_BITS, small: int = SMALL, each: int = EACH, heads: int = HEADS) -> DataFrame:
    """The input's rows with ``text_col`` cut to the lines that stay; adds ``n_lines``, ``n_removed``.

    Lines end at a line feed and are joined by it again; words are what ASCII white space
    separates, A-Z in lower case. Lines without words always stay. Documents are ordered by
    id, which is a whole number; rows that repeat an id are one document (each gets the same
    lines of its own text); a row with a null id is left alone, as is a null text (0 lines).
    Lines and texts of any length are compared whole; an empty table gives an empty result.
    Other columns pass whatever their names, but n_lines and n_removed, which are replaced.
    """
    id_, text = F.col(quoted(id_col)).cast("bigint"), F.col(quoted(text_col))
    rows = df.where(id_.isNotNull()).select(id_.alias("doc"), text.alias("text"))
    gone, drop = gone_lines(rows, word_counts(df, text_col), percent, bits=bits, small=small, each=each, heads=heads)
    per_doc = cut(gone.groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("gone")))
    drop()
    release(df.sparkSession)
    return _without(df, per_doc, id_col, text_col, bits)


def _without(df: DataFrame, per_doc: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """Only documents that lose lines are shuffled; the filter lets the others pass by."""
    doc, lost, touched_name = fresh(df, "doc", "gone", "touched")
    text, id_ = F.col(quoted(text_col)), F.col(quoted(id_col)).cast("bigint")
    names = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    others = [F.col(quoted(c)) for c in names if c != text_col]
    lines = F.split(text, "\n")
    n = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines")
    touched = bitmap(per_doc.select(slot(bits, F.col("doc")).alias("at")), "at")
    rows = mark(df, slot(bits, id_), touched, touched_name)
    plain = rows.where(~F.col(touched_name)).select(*others, text, n, F.lit(0).cast("bigint").alias("n_removed"))
    met = rows.where(F.col(touched_name)).join(per_doc.toDF(doc, lost), id_ == F.col(doc), "left")
    gone = F.coalesce(F.col(lost), F.array().cast("array<int>"))
    stay = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.array_contains(gone, i).alias("g"))), lambda s: ~s["g"])
    left = F.when(text.isNotNull(), F.array_join(F.transform(stay, lambda s: s["x"]), "\n"))
    changed = met.select(*others, left.alias(text_col), n, F.size(gone).cast("bigint").alias("n_removed"))
    return plain.unionByName(changed).select(*[quoted(c) for c in names], "n_lines", "n_removed")


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars_left and text_sha256 of what is left of each document."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    left = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length(left).cast("bigint").alias("n_chars_left"), F.sha2(left, 256).alias("text_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents
), w AS (
  SELECT doc_id, no, line, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS s FROM l
), c AS (
  SELECT s, len(s) AS n, min((doc_id, no)) AS at, row_number() OVER (ORDER BY min((doc_id, no))) AS c FROM w WHERE len(s) > 0 GROUP BY s
), t AS (
  SELECT c, n, unnest(s) AS word FROM c
), f AS (
  SELECT word, count(*) AS f FROM t GROUP BY word
), p AS (
  SELECT c, word FROM (SELECT c, n, word, row_number() OVER (PARTITION BY c ORDER BY f, word) AS k FROM t JOIN f USING (word)) WHERE k <= n - (80 * n + 99) // 100 + 1
), m AS (
  SELECT DISTINCT a.c AS a, b.c AS b FROM p a JOIN p b ON a.word = b.word AND a.c < b.c
), late AS (
  SELECT DISTINCT m.b AS c FROM (SELECT m.a, m.b, x.n + y.n AS n, len(list_intersect(x.s, y.s)) AS shared FROM m JOIN c x ON x.c = m.a JOIN c y ON y.c = m.b) m WHERE 100 * shared >= 80 * (n - shared)
), g AS (
  SELECT w.doc_id, w.no, w.line, len(w.s) > 0 AND (c.at <> (w.doc_id, w.no) OR late.c IS NOT NULL) AS gone FROM w LEFT JOIN c ON c.s = w.s LEFT JOIN late ON late.c = c.c
), d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id
)
SELECT o.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, length(coalesce(kept, '')) AS n_chars_left, sha256(coalesce(kept, '')) AS text_sha256
FROM documents o LEFT JOIN d ON d.doc_id = o.doc_id
"""
