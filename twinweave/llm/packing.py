"""Packing by non-negative least squares over length combinations."""

from __future__ import annotations

import array
import functools
import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinweave.llm.pieces import distinct, give_back
from twinweave.llm.token_counts import byte_alphabet
from twinweave.runtime import materialise, small_batches

END_ID = 1
#: White-space-free parts, and ids of distinct pieces, remembered per worker.
PARTS = 100_000
IDS = 1 << 20
#: Characters handled at once; a longer text is cut at white space.
GROUP = 1 << 19
#: Partitions whose offsets are broadcast: at most 16 KB each.
PARTITION_BOUND = 2_000
#: Third parts tried for each first part of a combination.
THIRDS = 8

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Recent(dict):
    """Remembered results of a function: when full, the current generation becomes the old one."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > 64:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


_NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NOT_PLAIN, SPACE, LETTER, DIGIT, OTHER = range(5)
#: Ranges in which every character folds alone, to one character, and is its own composed form.
PLAIN = ((0x21, 0x7F), (0xA1, 0xA8), (0xA9, 0xAA), (0xAB, 0xAF), (0xBF, 0x130), (0x131, 0x1C4), (0x1CD, 0x1F1), (0x1F4, 0x250), (0x400, 0x460), (0x2010, 0x2028), (0x2030, 0x203F), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and folded form of every code point; what isn't plain is left to the library."""
    kind, fold = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for low, high in PLAIN:
        for i in range(low, high):
            kind[i] = {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(i))[0], OTHER)
            fold[i] = ord(chr(i).lower())
    kind[[0x20, 0xA0, *range(0x09, 0x0E)]] = SPACE
    return kind, fold


def piece_bounds(points: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the split's pieces in folded plain text that begins and ends in white space."""
    before = np.concatenate([[SPACE], kind[:-1]])
    starts = (kind == DIGIT) | (kind >= LETTER) & (kind != before)
    # An apostrophe that opens a piece takes the letters after it that make a contraction.
    quotes = np.flatnonzero((points == ord("'")) & (before != OTHER))
    if len(quotes):
        at = np.minimum(quotes[:, None] + (1, 2), len(points) - 1)
        one, two = points[at[:, 0]], points[at[:, 1]]
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        found = short | pair
        opened, after = quotes[found] + 1, quotes[found] + np.where(short[found], 2, 3)
        starts[opened] = False
        starts[after[kind[after] >= LETTER]] = True
    begin = np.flatnonzero(starts)
    ends = np.flatnonzero((kind != SPACE) & (np.concatenate([kind[1:], [SPACE]]) == SPACE)) + 1
    stop = np.empty(len(begin), np.int64)
    stop[:-1] = begin[1:]
    last = np.searchsorted(begin, ends) - 1
    stop[last] = ends
    return begin, stop


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit numbers.

    The file's split never crosses white space, so a text is the run of its pieces.
    Texts of plain characters (PLAIN) are folded and split in numpy, all of a group
    at once; each distinct piece goes to the library once and its ids are
    remembered. Other texts are taken by white-space-free parts, which go to the
    library as they are. A file with another normalizer or split, or with ids that
    tails can't hold, is refused.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        levels = [x for x in spec["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"]]
        steps = [x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"] if spec["pre_tokenizer"]["type"] == "Sequence" else []
        if (spec["normalizer"] or {}).get("normalizers") != _NORMALISED or [(x["pattern"], x["behavior"], x["invert"]) for x in steps] != [({"Regex": _SPLIT}, "Removed", True)] or len(levels) != 1 or len(spec["pre_tokenizer"]["pretokenizers"]) != 2:
            raise ValueError("only files with the known folding and split are encoded")
        if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) > 0xFFFF:
            raise ValueError("token ids above 65535 don't fit the tails")
        self.library = Tokenizer.from_file(path)
        self.merges, self.written = self.library.model, byte_alphabet()
        self.odd = re.compile("[\x1c-\x1f]").search
        self.clear()

    def clear(self) -> None:
        self.parts = Recent(self.ask, PARTS)
        self.number: dict[str, int] = {}
        self.lengths, self.flat = array.array("q"), array.array("H")

    def ask(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Any text, by parts."""
        if self.odd(text):  # white space to Python, not to the file's pattern
            return self.ask(text)
        return b"".join(map(self.parts.__getitem__, text.split()))

    def ids_of(self, piece: str) -> list[int]:
        """Ids of one folded piece by the file's merges alone: it needs no folding or split any more, only its bytes as the file writes them."""
        if not piece.isascii():
            piece = "".join(map(self.written.__getitem__, piece.encode()))
        return [t.id for t in self.merges.tokenize(piece)]

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces in the table of remembered ids."""
        if len(self.flat) > IDS:
            self.clear()
        out = np.empty(len(pieces), np.int64)
        for i, piece in enumerate(pieces):
            k = self.number.get(piece)
            if k is None:
                k = self.number[piece] = len(self.lengths)
                ids = self.ids_of(piece)
                self.lengths.append(len(ids))
                self.flat.extend(ids)
            out[i] = k
        return out

    def plain(self, texts: list[str], points: np.ndarray, kind: np.ndarray, joined: str) -> list[bytes]:
        """Texts of plain characters; ``joined`` has a line feed before, between and after them."""
        points = _tables()[1][points]
        begin, stop = piece_bounds(points, kind)
        if not len(begin):
            return [b""] * len(texts)
        first, same = distinct(points, begin, stop)
        lowered = [joined[a:b].lower() for a, b in zip(begin[first].tolist(), stop[first].tolist(), strict=True)]
        which = self.numbers(lowered)[same]
        lengths = np.frombuffer(self.lengths, np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        n = lengths[which]
        ends = np.cumsum(n)
        total = int(ends[-1])
        ids = np.frombuffer(self.flat, np.uint16)[np.arange(total) - np.repeat(ends - n - offsets[which], n)].astype("<u4")
        del lengths
        edges = np.cumsum([1] + [len(t) + 1 for t in texts])
        cuts = np.concatenate([[0], ends])[np.searchsorted(begin, edges)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def group(self, texts: list[str]) -> list[bytes]:
        """Ids of a few texts of together about GROUP characters."""
        joined = "\n".join(["", *texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = _tables()[0][points]
        edges = np.cumsum([1] + [len(t) + 1 for t in texts])
        bad = np.add.reduceat(kind == NOT_PLAIN, edges[:-1], dtype=np.int64) > 0 if texts else np.zeros(0, bool)
        slow = {i: self.encode(t) for i, t in enumerate(texts) if bad[i] or "<|" in t}
        if not slow:
            return self.plain(texts, points, kind, joined)
        rest = [t for i, t in enumerate(texts) if i not in slow]
        found = iter(self.group(rest) if rest else [])
        return [slow[i] if i in slow else next(found) for i in range(len(texts))]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, in groups; a long text is cut at white space."""
        pieces, owner = [], []
        for i, text in enumerate(texts):
            at = 0
            while len(text) - at > GROUP and not self.odd(text):
                cut = max(text.rfind(" ", at, at + GROUP), text.rfind("\n", at, at + GROUP))
                if cut <= at:
                    m = re.compile(r"[ \n]").search(text, at + 1)
                    cut = m.start() if m else len(text)
                if cut >= len(text):
                    break
                pieces.append(text[at:cut])
                owner.append(i)
                at = cut
            pieces.append(text[at:] if at else text)
            owner.append(i)
        out, run, size = [], [], 0
        for t in pieces:
            if run and size + len(t) > GROUP:
                out += self.group(run)
                run, size = [], 0
            run.append(t)
            size += len(t) + 1
        out += self.group(run) if run else []
        if len(pieces) == len(texts):
            return out
        joined: list[list[bytes]] = [[] for _ in texts]
        for i, ids in zip(owner, out, strict=True):
            joined[i].append(ids)
        return [b"".join(x) for x in joined]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


_TAILS_DDL = "pid int, windows_before long, doc_id long, doc_tokens long, crcs array<long>, bin int, local_rank long, tail binary"
_TAILS = pa.schema(
    [("pid", pa.int32()), ("windows_before", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("bin", pa.int32()), ("local_rank", pa.int64()), ("tail", pa.binary())]
)


def _tokenised(path: str, window: int):
    def run(batches):
        own, pid, seen, windows = encoder(path), TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        last = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            encoded = own.encode_all([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += last
                n = len(ids) // 4
                whole, bin_ = n // window, n % window
                crcs = [zlib.crc32(ids[4 * window * i : 4 * window * (i + 1)]) for i in range(whole)]
                out.append((pid, windows, doc_id, n, crcs, bin_, int(seen[bin_]), np.frombuffer(ids[4 * window * whole :], "<u4").astype("<u2").tobytes()))
                seen[bin_] += 1
                windows += whole
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _TAILS, strict=True)], schema=_TAILS)
        own.clear()  # what a task remembers, the worker needn't hold between tasks
        give_back()

    return run


def combinations(lengths: np.ndarray, window: int, thirds: int = THIRDS) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a window exactly."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = [(a, window - a, 0) for a in lengths.tolist() if a >= window - a and have[window - a]]
    for a in lengths.tolist():
        rest = window - a
        b = lengths[(lengths <= min(a, rest - 1)) & (lengths * 2 >= rest)]
        b = b[have[rest - b]]
        for x in b[np.unique(np.linspace(0, len(b) - 1, min(thirds, len(b))).astype(int))].tolist() if len(b) else []:
            out.append((a, x, rest - x))
    return np.array(out, np.int64).reshape(-1, 3)


def nnls(parts: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, A counting parts per length.

    Accelerated projected gradient; a column has at most three entries, so a step
    costs three gathers and three sums.
    """
    if not len(parts):
        return np.zeros(0)
    use = (parts > 0).astype(float)
    target = histogram.astype(float)
    target[0] = 0
    degree = np.zeros(len(histogram))
    for k in range(3):
        np.add.at(degree, parts[:, k], use[:, k])
    rate = 1.0 / max(3.0 * degree.max(), 1.0)
    x = y = np.zeros(len(parts))
    t = 1.0
    for _ in range(steps):
        fill = sum(np.bincount(parts[:, k], y * use[:, k], len(histogram)) for k in range(3))
        gap = fill - target
        following = np.maximum(y - rate * sum(gap[parts[:, k]] * use[:, k] for k in range(3)), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = np.maximum(following + (t - 1) / t2 * (following - x), 0)
        x, t = following, t2
    return x


class Plan:
    """Where the k-th piece of each length goes. Its size is bounded by the window."""

    def __init__(self, histogram: np.ndarray, window: int):
        lengths = np.flatnonzero(histogram[1:]) + 1
        parts = combinations(lengths, window)
        repeats, left = nnls(parts, histogram), histogram.astype(np.int64).copy()
        self.window = window
        slots: list[list[tuple[int, int, int]]] = [[] for _ in range(window + 1)]
        sequences = 0
        for i in np.argsort(-repeats, kind="stable").tolist():
            own = [int(p) for p in parts[i] if p]
            n = int(min([round(float(repeats[i])), *(left[p] // own.count(p) for p in set(own))]))
            if n <= 0:
                continue
            offset = 0
            for p in own:  # n repeats, each with a slot for this part
                slots[p].append((n, sequences, offset))
                left[p] -= n
                offset += p
            sequences += n
        self.first = [np.cumsum([0, *(s[0] for s in own)]) for own in slots]
        self.slots = slots
        # What is left lies in one line, longest first, cut at every window.
        self.line = np.zeros(window + 1, np.int64)
        at = 0
        for p in range(window, 0, -1):
            self.line[p] = at
            at += int(left[p]) * p if p < len(left) else 0
        self.line_at, self.line_length = sequences, at
        whole = at // window
        self.cuts, pos = [], whole * window  # the rest becomes sequences of powers of two
        for bit in range(window.bit_length() - 1, -1, -1):
            if (at - whole * window) >> bit & 1:
                self.cuts.append((pos, sequences + whole + len(self.cuts)))
                pos += 1 << bit
        self.sequences = sequences + whole + len(self.cuts)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of the pieces that the rank-th tail of this length becomes."""
        first = self.first[length]
        if rank < first[-1]:
            k = int(np.searchsorted(first, rank, "right")) - 1
            _, sequence, offset = self.slots[length][k]
            return [(length, sequence + rank - int(first[k]), offset)]
        pos, out = int(self.line[length]) + (rank - int(first[-1])) * length, []
        whole = self.line_length // self.window * self.window
        while length:
            if pos < whole:
                start, sequence = pos // self.window * self.window, self.line_at + pos // self.window
                end = start + self.window
            else:
                k = max(i for i, c in enumerate(self.cuts) if c[0] <= pos)
                start, sequence = self.cuts[k]
                end = self.cuts[k + 1][0] if k + 1 < len(self.cuts) else self.line_length
            n = min(length, end - pos)
            out.append((n, sequence, pos - start))
            pos, length = pos + n, length - n
        return out


def _pieces(plan: Plan, window: int):
    schema = pa.schema([(n.split()[0], pa.int64()) for n in _PIECES.split(", ")])

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("pid", "windows_before", "doc_id", "doc_tokens", "crcs", "bin", "rank", "tail")}
            out: list[tuple] = []
            for pid, before, doc_id, n, crcs, bin_, rank, tail in zip(*cols.values(), strict=True):
                for i, crc in enumerate(crcs):
                    out.append((doc_id, i * window, window, crc, n, plan.sequences + (pid << 40) + before + i, 0))
                if bin_:
                    ids, at = np.frombuffer(tail, "<u2").astype("<u4").tobytes(), 0
                    for length, sequence, offset in plan.place(bin_, rank):
                        out.append((doc_id, len(crcs) * window + at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, sequence, offset))
                        at += length
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document's ids, closed by END_ID, into sequences of ``window`` ids.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A null text is empty and still has END_ID. Repeated rows
    are packed each; an empty table gives no rows; other columns are not read.

    Full windows are sequences of their own. The histogram of the remaining
    lengths has ``window`` bins whatever the corpus. Combinations of two or three
    lengths that fill a window get repeat counts by non-negative least squares,
    which are rounded and taken as far as the histogram allows; the rest is packed
    greedily, longest first, in one line that is cut at every window, and what
    remains at its end becomes sequences whose lengths are powers of two. Of triples,
    THIRDS second lengths are tried for each first one, and the solver takes a fixed
    number of steps: both bound the plan, not what is packed. A tail's
    place follows from its length and its rank among equal lengths, so only ranks
    are exchanged: counts by partition and length.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tails = materialise(given.mapInArrow(_tokenised(tokenizer, window), _TAILS_DDL), "pack-tails")
    counts = tails.groupBy("pid", "bin").agg(F.count("*").alias("n"))
    counts = materialise(counts, "pack-counts")
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        histogram[r.bin] = r.n
    before = Window.partitionBy("bin").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pid", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # A row per partition of the tails, at most ``window`` numbers each: broadcast up to PARTITION_BOUND, else joined.
    offsets = offsets.groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("bin", "first"))).alias("first"))
    small = counts.select("pid").distinct().count() <= PARTITION_BOUND
    ranked = tails.join(F.broadcast(offsets) if small else offsets.hint("merge"), "pid").withColumn("rank", F.element_at("first", F.col("bin")) + F.col("local_rank"))
    return ranked.select("pid", "windows_before", "doc_id", "doc_tokens", "crcs", "bin", "rank", "tail").mapInArrow(_pieces(Plan(histogram, window), window), _PIECES)
