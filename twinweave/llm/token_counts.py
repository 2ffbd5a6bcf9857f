"""Token counts by finite-state transducers.

The tokenizer file is compiled into two deterministic transducers:

* a split transducer over character classes, whose transitions are annotated with
  the starts of pieces they reveal. Texts are cut into chunks; every chunk yields
  a map from entry state to exit state, and the maps compose (an associative
  operation) through a parallel prefix scan, after which all chunks run at once;
* a merge transducer over bytes, whose transitions are annotated with the change
  in the number of emitted tokens. A state holds the last token of the canonical
  encoding at each cut that a later token could still reach back to, so it is
  finite; states are determinised when first met. Distinct pieces run side by side;
  a long piece is cut into chunks, whose maps from entry to exit state, with the
  tokens emitted on the way, compose through the same scan.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.pieces import distinct, give_back
from twinweave.runtime import small_batches

CHUNK = 256
#: Characters handled at once; longer texts are read in stretches of as many.
GROUP = 1 << 20
#: Pieces and token pairs, and merge states, remembered per worker before they start afresh.
REMEMBERED = 250_000
STATES = 120_000
#: Pieces, or chunks of one, that run side by side.
LANES = 4096

#: Split classes. The letters that the split pattern names after an apostrophe.
LETTER, SHORT, R, V, LL, E, NUMBER, SPACE, WHITE, QUOTE, OTHER, END = range(12)
START, IN_L, IN_N, IN_O, APOS, APOS_R, APOS_V, APOS_L, DONE, S1, W1, SN, WN = range(13)
HERE, BEFORE = 1, 2
#: White space beside the space itself, as Unicode's White_Space property has it.
WHITE_POINTS = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.array([kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    table[WHITE_POINTS] = WHITE
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    for letters, c in (("stmd", SHORT), ("r", R), ("v", V), ("l", LL), ("e", E)):
        table[[ord(x) for x in letters]] = c
    return table


@functools.cache
def split_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, revealed starts) by class and state, for the byte-level split pattern."""
    letters = (LETTER, SHORT, R, V, LL, E)
    nxt, out = np.zeros((12, 13), np.uint8), np.zeros((12, 13), np.uint8)

    def put(state, cls, to, bits):
        nxt[cls, state], out[cls, state] = to, bits

    def fresh(state, bits):
        """What any class does where a new piece starts at it."""
        for c in letters:
            put(state, c, IN_L, bits)
        for c, to in ((NUMBER, IN_N), (SPACE, S1), (WHITE, W1), (QUOTE, APOS), (OTHER, IN_O)):
            put(state, c, to, bits)

    for s in (START, IN_L, IN_N, IN_O, APOS, DONE, W1):
        fresh(s, HERE)
    for s in (APOS_R, APOS_V, APOS_L):  # the letter after the apostrophe opened a piece after all
        fresh(s, BEFORE | HERE)
        for c in letters:
            put(s, c, IN_L, BEFORE)
        put(s, END, START, BEFORE)
    put(APOS_R, E, DONE, 0)
    put(APOS_V, E, DONE, 0)
    put(APOS_L, LL, DONE, 0)
    for c in letters:
        put(IN_L, c, IN_L, 0)
    put(IN_N, NUMBER, IN_N, 0)
    for s in (IN_O, APOS):
        put(s, OTHER, IN_O, 0)
        put(s, QUOTE, IN_O, 0)
    for c, to in ((SHORT, DONE), (R, APOS_R), (V, APOS_V), (LL, APOS_L)):
        put(APOS, c, to, 0)
    for s, bits in ((S1, 0), (SN, BEFORE)):  # one space joins what follows it
        for c in letters:
            put(s, c, IN_L, bits)
        put(s, NUMBER, IN_N, bits)
        put(s, OTHER, IN_O, bits)
        put(s, QUOTE, IN_O, bits)
    fresh(WN, BEFORE | HERE)
    for s in (S1, W1, SN, WN):
        put(s, SPACE, SN, 0)
        put(s, WHITE, WN, 0)
    return nxt, out


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (chunks x states), in log2 steps."""
    done, step = maps.copy(), 1
    while step < len(done):
        done[step:] = np.take_along_axis(done[step:], done[:-step], axis=1)
        step *= 2
    return done


def split_bits(points: np.ndarray, state: int = START) -> tuple[np.ndarray, int]:
    """(revealed starts, exit state) of class codes read from ``state`` on."""
    nxt, out = split_transducer()
    flat_next, flat_out = nxt.ravel(), out.ravel()
    rows = -(-len(points) // CHUNK)
    grid = np.full(rows * CHUNK, END, np.uint8)
    grid[: len(points)] = points
    steps = np.ascontiguousarray(grid.reshape(rows, CHUNK).T).astype(np.int32) * 13
    lanes = np.tile(np.arange(13, dtype=np.uint8), (rows, 1))
    for i in range(CHUNK):
        lanes = flat_next[steps[i][:, None] + lanes]
        if i % 8 == 7 and lanes.shape[1] > 1 and (lanes == lanes[:, :1]).all():
            lanes = lanes[:, :1]  # every entry state has met: one lane stands for all
    maps = np.broadcast_to(lanes, (rows, 13)) if lanes.shape[1] == 1 else lanes
    entry = np.empty(rows, np.uint8)
    entry[:1], entry[1:] = state, scan_maps(np.ascontiguousarray(maps))[:-1, state]
    bits, at_end = np.empty((CHUNK, rows), np.uint8), state
    for i in range(CHUNK):
        at = steps[i] + entry
        bits[i], entry = flat_out[at], flat_next[at]
        if rows and (rows - 1) * CHUNK + i == len(points) - 1:
            at_end = int(entry[-1])
    return bits.T.ravel()[: len(points)], at_end


def piece_starts(points: np.ndarray) -> np.ndarray:
    """True where a piece starts. points: class codes, every text closed by END."""
    bits, _ = split_bits(points)
    starts = (bits & HERE) > 0
    starts[:-1] |= (bits[1:] & BEFORE) > 0
    return starts


class MergeTransducer:
    """Bytes in, change of the token count out; determinised on demand."""

    def __init__(self, vocab: dict[str, int], merges: list):
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        coded = lambda s: bytes(back[c] for c in s)
        self.tokens = sorted(coded(t) for t in vocab if all(c in back for c in t))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        number = {t: i for i, t in enumerate(self.tokens)}
        # The rank of the merge of two tokens, and of each token the merge that makes it (-1: a single byte).
        self.ranks = {number[coded(a)] << 20 | number[coded(b)]: r for r, (a, b) in enumerate(pairs)}
        self.made, self.halves = [-1] * len(self.tokens), [(-1, -1)] * len(self.tokens)
        for pair, r in self.ranks.items():
            whole = number[self.tokens[pair >> 20] + self.tokens[pair & 0xFFFFF]]
            if self.made[whole] >= 0:
                raise ValueError("two merges make one token")
            self.made[whole], self.halves[whole] = r, (pair >> 20, pair & 0xFFFFF)
        # The tokens as a tree: child by node and byte, the token that ends at a node (-1: none), whether it goes on.
        self.child: dict[int, int] = {}
        self.token, self.goes_on = [-1], [False]
        for i, t in enumerate(self.tokens):
            node = 0
            for byte in t:
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.goes_on.append(False)
                    self.goes_on[node] = True
                node = to
            self.token[node] = i
        self.fits: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        # A state: each cut that a later token can still start from, packed: the tree's node of the bytes since,
        # the last token of the encoding there (one past all: none), and its tokens less those of the whole.
        self.states: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        # By state and column: the next state (-1: not met yet) and the change of the token count.
        # Bytes get columns when first met.
        self.column, self.columns = np.full(256, -1, np.int16), 0
        self.next, self.change = np.full((1024, 32), -1, np.int32), np.zeros((1024, 32), np.int16)
        self.state_of((len(self.tokens) << 16 | 1 << 15,))

    def state_of(self, key: tuple[int, ...]) -> int:
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to == len(self.next):
                more = to // 2
                self.next = np.concatenate([self.next, np.full((more, self.next.shape[1]), -1, np.int32)])
                self.change = np.concatenate([self.change, np.zeros((more, self.next.shape[1]), np.int16)])
        return to

    def columns_of(self, data: np.ndarray) -> np.ndarray:
        """The columns of bytes."""
        found = self.column[data]
        if found.size and found.min() < 0:
            for byte in np.unique(data[found < 0]).tolist():
                if self.columns == self.next.shape[1]:
                    self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
                    self.change = np.concatenate([self.change, np.zeros_like(self.change)], axis=1)
                self.column[byte], self.columns = self.columns, self.columns + 1
            found = self.column[data]
        return found

    def side_by_side(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge ranked before ``limit`` joins the end of token a with the start of token b.

        The merges that made the two are undone at their common border, latest first
        (of equal ranks the left one was made first); what then lies at the border
        must not have merged before.
        """
        made, halves, ranks = self.made, self.halves, self.ranks
        while True:
            if ranks.get(a << 20 | b, limit) < limit:
                return False
            if made[a] > made[b]:
                limit, a = made[a], halves[a][1]
            elif made[b] >= 0:
                limit, b = made[b] + 1, halves[b][0]
            else:
                return True

    def fit(self, last: int, token: int) -> bool:
        """Whether the canonical encoding of both keeps them as they are; last may be none."""
        key = last << 20 | token
        found = self.fits.get(key)
        if found is None:
            if last == len(self.tokens):  # a token alone: its halves, in their turn, merge last
                a, b = self.halves[token]
                found = a < 0 and len(self.tokens[token]) == 1 or a >= 0 and self.fit(last, a) and self.fit(last, b) and self.side_by_side(a, b, self.made[token])
            else:
                found = self.fit(len(self.tokens), token) and self.side_by_side(last, token, len(self.ranks))
            self.fits[key] = found
        return found

    def move(self, state: int, byte: int) -> None:
        """Determinises one transition: the longest token that ends here and fits at its cut is emitted."""
        cuts, best = [], -1
        for cut in self.states[state]:
            to = self.child.get(cut >> 34 << 8 | byte)
            if to is not None:
                token = self.token[to]
                if best < 0 <= token and self.fit(cut >> 16 & 0x3FFFF, token):
                    best, now = token, (cut & 0xFFFF) - (1 << 15) + 1
                if self.goes_on[to]:
                    cuts.append(to << 34 | cut & 0x3FFFFFFFF)
        if best < 0:
            raise ValueError("the merges give no canonical encoding")
        to = self.state_of((*[c - now for c in cuts], best << 16 | 1 << 15))
        at = self.columns_of(np.array([byte]))[0]
        self.next[state, at], self.change[state, at] = to, now

    def advance(self, states: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit states, tokens emitted) of lanes side by side; lane i reads data[i, :lengths[i]], longest lane first."""
        states, totals, columns = states.copy(), np.zeros(len(states), np.int64), self.columns_of(data)
        for i in range(data.shape[1] if len(states) else 0):
            n = int(np.searchsorted(-lengths, -i, "left"))  # lanes longer than i
            at, column = states[:n], columns[:n, i]
            to = self.next[at, column]
            if len(to) and to.min() < 0:
                for key in np.unique(at[to < 0].astype(np.int64) << 8 | data[:n, i][to < 0]).tolist():
                    self.move(key >> 8, key & 255)
                to = self.next[at, column]
            totals[:n] += self.change[at, column]
            states[:n] = to
        return states, totals

    def rest(self, state: int) -> int:
        """``state``, also after a fresh start if too much is remembered."""
        if len(self.fits) > 4 * REMEMBERED:
            self.fits.clear()
        if len(self.states) > STATES:
            key = self.states[state]
            self.clear()
            state = self.state_of(key)
        return state

    def through(self, data: bytes, state: int = 0) -> tuple[int, int]:
        """(exit state, tokens emitted) of a long piece, by the maps of its chunks.

        A chunk's map is kept for the entry states that can occur: the first one and
        whatever the chunk before can leave, from any of its own. Started anywhere,
        runs soon meet, so these sets close after a few rounds.
        """
        total, whole = 0, len(data) // CHUNK * CHUNK
        grid = np.frombuffer(data[:whole], np.uint8).reshape(-1, CHUNK)
        for first in range(0, len(grid), LANES):
            chunks = grid[first : first + LANES]
            state = self.rest(state)
            entries: list[dict[int, int]] = [{0: 0} if i else {state: 0} for i in range(len(chunks))]
            exits: list[list[tuple[int, int]]] = [[] for _ in chunks]
            open_ = [(i, s) for i, e in enumerate(entries) for s in e]
            while open_:
                lane, entry = np.array([o[0] for o in open_]), np.array([o[1] for o in open_], np.int32)
                to, emitted = self.advance(entry, chunks[lane], np.full(len(lane), CHUNK))
                open_ = []
                for i, s, n in zip(lane.tolist(), to.tolist(), emitted.tolist(), strict=True):
                    exits[i].append((s, n))
                    if i + 1 < len(chunks) and s not in entries[i + 1]:
                        entries[i + 1][s] = len(entries[i + 1])
                        open_.append((i + 1, s))
            width = max(map(len, entries))
            maps, counts = np.zeros((len(chunks), width), np.int64), np.zeros((len(chunks), width), np.int64)
            for i, own in enumerate(exits):
                for c, (s, n) in enumerate(own):
                    maps[i, c], counts[i, c] = entries[i + 1][s] if i + 1 < len(chunks) else c, n
            entered = np.concatenate([[0], scan_maps(maps)[:-1, 0]])
            total += int(counts[np.arange(len(chunks)), entered].sum())
            state = exits[-1][int(entered[-1])][0]
        last = np.frombuffer(data[whole:], np.uint8).reshape(1, -1)
        to, emitted = self.advance(np.array([state], np.int32), last, np.array([last.shape[1]]))
        return int(to[0]), total + int(emitted[0])

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece."""
        lengths, out = np.array([len(p) for p in pieces], np.int64), np.zeros(len(pieces), np.int64)
        order = np.argsort(-lengths, kind="stable")
        for i in order[lengths[order] > CHUNK].tolist():
            out[i] = self.through(pieces[i])[1]
        order = order[lengths[order] <= CHUNK]
        for first in range(0, len(order), LANES):
            own = order[first : first + LANES]
            self.rest(0)
            n = lengths[own]
            flat = np.frombuffer(b"".join(pieces[i] for i in own.tolist()) + bytes(int(n[0])), np.uint8)
            data = flat[(np.cumsum(n) - n)[:, None] + np.arange(int(n[0]))]
            out[own] = self.advance(np.zeros(len(own), np.int32), data, n)[1]
        return out


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Counter:
    """Numbers of tokens of pieces; those met before are remembered."""

    def __init__(self, model: MergeTransducer):
        self.model, self.known = model, {}

    def clear(self) -> None:
        self.known = {}
        self.model.clear()

    def __call__(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        found = [self.known.get(p, -1) for p in pieces]
        new = [i for i, n in enumerate(found) if n < 0]
        for i, n in zip(new, self.model.count([pieces[i].encode() for i in new]).tolist(), strict=True):
            found[i] = n
            if len(pieces[i]) <= 64:
                self.known[pieces[i]] = n
        return np.array(found, np.int64)


@functools.cache
def compiled(path: str) -> tuple[Counter, tuple[str, ...]]:
    """The transducers of a byte-level tokenizer file, and its added strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
        raise ValueError("only byte-level files without normalizer and prefix space are compiled")
    added = tuple(t["content"] for t in spec["added_tokens"])
    return Counter(MergeTransducer(spec["model"]["vocab"], spec["model"]["merges"])), added


def count_group(texts: list[str], path: str) -> list[int]:
    """Token counts of texts, all in one pass of the transducers."""
    counter, added = compiled(path)
    parts, owner, extra = [], [], [0] * len(texts)
    for i, text in enumerate(texts):
        segments = [text]
        for special in added:  # an added string is one token and parts the text around it
            if special in text:
                segments = [y for x in segments for y in x.split(special)]
        extra[i] = len(segments) - 1
        parts += segments
        owner += [i] * len(segments)
    counts = np.zeros(len(parts), np.int64)
    long = [i for i, p in enumerate(parts) if len(p) > GROUP]
    counts[long] = [count_long(parts[i], counter) for i in long]
    short = [i for i, p in enumerate(parts) if len(p) <= GROUP]
    parts = [parts[i] for i in short]
    joined = "\0".join([*parts, ""])
    numbers = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    points = classes()[numbers]
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) - 1
    points[ends] = END
    starts = piece_starts(points)
    starts[ends] = False
    at = np.flatnonzero(starts)
    begins = ends - np.array([len(p) for p in parts], np.int64)
    low, high = np.searchsorted(at, begins), np.searchsorted(at, ends)
    stop = np.empty(len(at), np.int64)
    stop[:-1] = at[1:]
    filled = high > low
    stop[high[filled] - 1] = ends[filled]
    if len(at):  # each distinct piece is priced by the merge transducer
        first, same = distinct(numbers, at, stop)
        price = counter([joined[a:b] for a, b in zip(at[first].tolist(), stop[first].tolist(), strict=True)])[same]
        running = np.concatenate([[0], np.cumsum(price)])
        counts[short] = running[high] - running[low]
    totals = np.array(extra, np.int64)
    np.add.at(totals, np.array(owner, np.int64), counts)
    return totals.tolist()


def count_long(text: str, counter: Counter) -> int:
    """Tokens of one long text, read in stretches; only a stretch and two states are held.

    The last character of a stretch may yet open a piece, so it waits for the next;
    what is before it in the open piece has gone through the merge transducer.
    """
    model, total, split, merge, held = counter.model, 0, START, 0, ""
    for first in range(0, len(text) + 1, GROUP):
        own, ends = text[first : first + GROUP], first + GROUP > len(text)
        points = classes()[np.frombuffer(own.encode("utf-32-le"), np.uint32)]
        bits, split = split_bits(np.append(points, END) if ends else points, split)
        window = held + own
        cut = np.zeros(len(held) + len(bits) + 1, bool)  # the first place stands for one before the window
        cut[len(held) + 1 :] = (bits & HERE) > 0
        cut[len(held) : -1] |= (bits & BEFORE) > 0
        at = np.flatnonzero(cut[1 : len(window) + 1]).tolist()
        if at:
            total += model.through(window[: at[0]].encode(), merge)[1]  # the end of the open piece
            total += int(counter([window[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]).sum())
            merge, window = 0, window[at[-1] :]
        fed = window if ends else window[:-1]
        merge, n = model.through(fed.encode(), merge)
        total, held = total + n, window[len(fed) :]
    return total


def groups(texts, most: int = GROUP):
    """Consecutive runs of texts of about ``most`` characters."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of whole texts.

    ``tokenizer`` is the path of a byte-level tokenizer file that every executor
    has. A null text counts as empty: 0 bytes, 0 tokens. Rows are independent, so
    ties and repeated rows are counted row by row, an empty table gives no rows
    and no shuffle is needed; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            n = [x for g in groups(t.as_py() or "" for t in batch.column(2)) for x in count_group(g, tokenizer)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        compiled(tokenizer)[0].clear()  # what a task remembers, the worker needn't hold between tasks
        give_back()

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return given.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
