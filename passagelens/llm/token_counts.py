"""Token counts by a finite-state tokenizer: a byte-level BPE compiled to a deterministic transducer.

Two machines run one after another over a batch of texts, both over whole columns of bytes at once.

1. Splitting. The split pattern of byte-level BPE looks at character classes only, so that the start of each
   piece follows from the classes of neighbouring characters.
2. Merging. The state of the transducer after a prefix of a piece is what later bytes can still change: for
   each place from which on the text so far begins some token, the last token before that place and the
   number of tokens since. A transition reads a byte and emits the change of the token count (which is negative
   where a byte lets tokens merge). The last token of a prefix is the only token that ends there and is
   compatible with the last token before it (two tokens are compatible if their bytes encode to just those two).
   States are built when they are first met and kept in dense tables; beyond MAX_STATES the tables start anew.

Texts are cut into chunks that run side by side. A chunk's state map takes an entry state to its exit state and count. It is constant
from its first piece start on, since every piece starts in the start state: that body runs first, for all chunks. The bytes
before it, the head, need the exit of the chunk before. Chunks without any piece start are all head: their maps are
filled for the entry states that occur, all chunks at once, and composed in a parallel prefix scan, by twice the distance in each
step. Where the scan meets an entry state that a map lacks, that state is filled in for all chunks and the scan runs
again; states forget what lies far back, so that few rounds do.

Special strings in a text count as one token each, as the tokenizers library does by default, and split the text.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows that repeat a doc_id, or have none, are counted one by
one; an empty table gives an empty table; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


CHUNK, MAX_STATES, FEW, TRIED, NEVER, SLOTS = 512, 131_000, 24, 60, 1 << 30, 8
LETTER, NUMBER, SPACE, BLANK, OTHER = 1, 2, 3, 4, 0
_SHORT = ("s", "t", "m", "d")
_LONG = ("re", "ve", "ll")


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of each code point; BLANK is U+0020 alone."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *([0xE000] * 0x800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[0x20] = BLANK
    return out


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character; first marks the first characters of texts."""
    n = len(codes)
    kind = char_classes()[codes]
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[0], before[1:] = SPACE, kind[:-1]
    after[-1], after[:-1] = SPACE, kind[1:]
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, first[1:]
    space, was_space = kind >= SPACE, (before >= SPACE) & ~first
    plain_before = np.where(before == BLANK, SPACE, before)
    starts = first.copy()
    # Within words: a new class starts a piece, but for what follows a blank, which starts at the blank.
    starts |= ~space & ~first & (plain_before != kind) & (before != BLANK)
    # White space: a run starts a piece; its last character stands apart if a word follows, and a blank joins that word.
    starts |= space & ~first & ~was_space
    starts |= space & was_space & ~last & (after < SPACE)
    # Contractions: an apostrophe that starts a piece takes the letters of 's, 't, 're, 've, 'm, 'll, 'd.
    for at in np.flatnonzero((codes == 0x27) & starts):
        rest = "".join(map(chr, codes[at + 1 : at + 3]))
        size = 1 if rest[:1] in _SHORT and rest else 2 if rest in _LONG else 0
        if size and not first[at + 1 : at + 1 + size].any():
            starts[at + 1 : at + 1 + size] = False
            end = at + 1 + size
            if end < n:
                starts[end] = True
    return starts


class Transducer:
    """The compiled merges. next/emit: by state * 256 + byte; -1 where a transition is not built yet."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        to_byte = self._bytes_of_chars()
        vocab = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        as_bytes = lambda t: bytes(to_byte[c] for c in t)
        self.ranks = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(pairs)}
        self.tokens = set(vocab)
        self.starts = {t[:k] for t in vocab for k in range(1, len(t))}
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        self.made = {a + b: (k, a, b) for (a, b), k in self.ranks.items()}
        self.wholes: dict[bytes, bool] = {}
        self.sorted = sorted(vocab)
        self.roles: dict[tuple[bytes, bytes], bytes | bool] = {}
        self.same: dict[tuple, bytes] = {}
        self.clear()

    @staticmethod
    def _bytes_of_chars() -> dict[str, int]:
        """Byte-level BPE writes printable bytes as themselves and the others as characters from U+0100 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next, self.emit = np.full(256 * 1024, -1, np.int32), np.zeros(256 * 1024, np.int8)
        self.state(((b"", b"", 0),))

    def state(self, key: tuple) -> int:
        if (found := self.ids.get(key)) is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            if (found + 1) * 256 > len(self.next):
                self.next = np.concatenate([self.next, np.full(len(self.next), -1, np.int32)])
                self.emit = np.concatenate([self.emit, np.zeros(len(self.emit), np.int8)])
        return found

    def encode(self, word: bytes) -> list[bytes]:
        """Merge the adjacent pair of least rank until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.ranks.get((parts[i], parts[i + 1]), NEVER), i))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def whole(self, token: bytes) -> bool:
        """Whether a token's own bytes encode to it."""
        if (known := self.wholes.get(token)) is None:
            known = self.wholes[token] = self.encode(token) == [token]
        return known

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether the bytes of tokens a and b encode to just these two (of b alone, if a is empty).

        Merges run by rank, and from left to right within one rank. Going back in time from (a, b), undo whichever of
        the two tokens at the seam came last; had the pair at the seam a rank before that, it would have merged.
        """
        if not self.whole(b):
            return False
        until = NEVER
        while a:
            if self.ranks.get((a, b), NEVER) < until:
                return False
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a and (not made_b or made_a[0] > made_b[0]):
                until, a = made_a[0], made_a[2]
            elif made_b:
                until, b = made_b[0] + 1, made_b[1]
            else:
                break
        return True

    def open_at(self, token: bytes, text: bytes) -> bytes | None:
        """What stands for `token` before an unfinished `text`: None if no token that begins with text fits after it,
        and one name for all tokens after which the same tokens fit."""
        if not text:
            return token
        if (known := self.roles.get((token, text))) is None:
            low, high = bisect_left(self.sorted, text), bisect_left(self.sorted, text + b"\xff" * 200)
            if high - low > TRIED:
                known = token
            else:
                fit = tuple(i for i in range(low, high) if self.sorted[i] != text and self.fits(token, self.sorted[i]))
                known = self.same.setdefault((text, fit), token) if fit else False
            self.roles[token, text] = known
        return None if known is False else known

    def build(self, state: int, byte: int) -> None:
        """The transition from a state by a byte. A state: its places, each the text since, the last token before and the tokens since."""
        one, token, emitted, moved = bytes([byte]), None, 0, []
        for text, last, since in self.states[state]:
            if token is None and text + one in self.tokens and self.fits(last, text + one):
                token, emitted = text + one, 1 - since
            if text + one in self.starts:
                moved.append((text + one, last, since))
        if token is None:
            raise ValueError(f"no token ends in byte {byte}")
        live = [(text, role, since + emitted) for text, last, since in moved if (role := self.open_at(last, text)) is not None]
        self.next[state * 256 + byte], self.emit[state * 256 + byte] = self.state((*live, (b"", token, 0))), emitted

    def run(self, data: np.ndarray, starts: np.ndarray, begin: np.ndarray, end: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs data[begin:end] of each lane from its entry state; the exit states and the counts."""
        order = np.argsort(begin - end, kind="stable")
        length = (end - begin)[order]
        at, state = begin[order].copy(), entry[order].astype(np.int64)
        count = np.zeros(len(order), np.int64)
        step, live = 0, int(np.searchsorted(-length, 0))
        while live > FEW:
            here = at[:live] + step
            now = np.where(starts[here], 0, state[:live])
            key = now * 256 + data[here]
            to = self.next[key]
            if (to < 0).any():
                for k in np.unique(key[to < 0]):
                    self.build(int(k) >> 8, int(k) & 255)
                to = self.next[key]
            state[:live] = to
            count[:live] += self.emit[key]
            step += 1
            live = int(np.searchsorted(-length, -step, side="left"))
        for lane in range(live):  # few and long
            s, total = int(state[lane]), 0
            for i in range(int(at[lane]) + step, int(at[lane] + length[lane])):
                key = (0 if starts[i] else s) * 256 + int(data[i])
                if self.next[key] < 0:
                    self.build(key >> 8, key & 255)
                s = int(self.next[key])
                total += int(self.emit[key])
            state[lane] = s
            count[lane] += total
        exit_, counts = np.empty_like(state), np.empty_like(count)
        exit_[order], counts[order] = state, count
        return exit_, counts

    def _fill(self, data: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exits and counts of chunks without piece starts, in runs; known: the entry state of each run's first chunk."""
        n = len(low)
        entry, exit_, count = np.full((n, SLOTS), -2, np.int64), np.full((n, SLOTS), -1, np.int64), np.zeros((n, SLOTS), np.int64)
        todo, wanted = np.arange(n), np.where(first, known, 0)  # inside runs the start state is a guess
        slot = 0
        while True:
            entry[todo, slot] = wanted
            exit_[todo, slot], count[todo, slot] = self.run(data, starts, low[todo], high[todo], wanted)
            through, _ = composed(first, entry, exit_, count)
            # A run's first chunk has its known entry in slot 0, and so have all prefixes.
            if (through[:, 0] >= 0).all():
                break
            newest = np.where(exit_[:, slot] >= 0, exit_[:, slot], exit_[:, 0])
            best = np.where(through[:, 0] >= 0, through[:, 0], newest)
            todo = np.flatnonzero(~first & ~(entry == np.roll(best, 1)[:, None]).any(axis=1))
            wanted = np.roll(best, 1)[todo]
            slot = slot + 1 if slot + 1 < SLOTS else 1
            resolved = ~first & (np.roll(through[:, 0], 1) >= 0)
            own = (entry == np.roll(through[:, 0], 1)[:, None]) & resolved[:, None]
            keep = own[:, slot]  # what the true prefix uses stays: in slot 0, whose guess is not needed any more
            entry[keep, 0], exit_[keep, 0], count[keep, 0] = entry[keep, slot], exit_[keep, slot], count[keep, slot]
        exits = through[:, 0]
        come = np.where(first, known, np.roll(exits, 1))
        at = (entry == come[:, None]).argmax(axis=1)
        return exits, count[np.arange(n), at]

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        if len(self.states) > MAX_STATES:
            self.clear()
        total = np.zeros(len(texts), np.int64)
        owner, parts = list(range(len(texts))), texts
        if self.special and any(any(s in t for s in self.special) for t in texts):
            cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
            owner, parts = [], []
            for k, t in enumerate(texts):
                own = cut.split(t)
                total[k] += len(own) - 1
                owner += [k] * len(own)
                parts += own
        sizes = np.array([len(p) for p in parts], np.int64)
        if not sizes.sum():
            return total
        joined = "".join(parts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        ends = np.cumsum(sizes)
        first = np.zeros(len(codes), bool)
        first[(ends - sizes)[sizes > 0]] = True
        by_char = piece_starts(codes, first)
        leads = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
        starts = np.zeros(len(data), bool)
        starts[leads[by_char]] = True
        edges = np.append(leads, len(data))
        begin, stop = edges[ends - sizes], edges[ends]

        # Chunks of all texts; the body of each begins with its first piece start.
        n_chunks = -(-(stop - begin) // CHUNK)
        text_of = np.repeat(np.arange(len(parts)), n_chunks)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        low = begin[text_of] + nth * CHUNK
        high = np.minimum(low + CHUNK, stop[text_of])
        at = np.append(np.flatnonzero(starts), len(data))
        body = np.minimum(at[np.searchsorted(at, low)], high)
        exits, chunk_counts = self.run(data, starts, body, high, np.zeros(len(low), np.int64))
        ends_known = body < high
        heads = np.flatnonzero(body > low)
        if len(heads):
            through = np.flatnonzero(~ends_known)
            if len(through):
                first = ends_known[through - 1]  # a text's first chunk begins with a piece
                exits[through], chunk_counts[through] = self._fill(data, starts, low[through], high[through], first, exits[through - 1])
            heads = heads[ends_known[heads]]
            chunk_counts[heads] += self.run(data, starts, low[heads], body[heads], exits[heads - 1])[1]
        per_part = np.zeros(len(parts), np.int64)
        np.add.at(per_part, text_of, chunk_counts)
        np.add.at(total, np.array(owner, np.int64), per_part)
        return total


def composed(first: np.ndarray, entry: np.ndarray, exit_: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix compositions of state maps: exit and count over all chunks from the first of a run on.

    A map is a row: entry[i, r] goes to exit_[i, r] with count[i, r], or has no value where exit_ is negative. Each step
    composes maps of twice the length, so that a run of n chunks takes log2(n) steps.
    """
    at = np.arange(len(first))
    begin = np.maximum.accumulate(np.where(first, at, 0))
    entry, exit_, count = entry.copy(), exit_.copy(), count.copy()
    reach = 1
    while len(here := np.flatnonzero(at - reach >= begin)):
        before = here - reach
        through = exit_[before]
        same = (entry[here][:, None, :] == through[:, :, None]) & (through >= 0)[:, :, None]
        slot, known = same.argmax(axis=2), same.any(axis=2)
        after = np.where(known, np.take_along_axis(exit_[here], slot, 1), -1)
        total = count[before] + np.take_along_axis(count[here], slot, 1)
        starts = entry[before]
        entry[here], exit_[here], count[here] = starts, after, total
        reach *= 2
    return exit_, count


@lru_cache(1)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, batch_chars: int = 4_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit). tokenizer: the file name of public_tokenizers."""

    def counted(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        machine = transducer(public_tokenizers.path(tokenizer))
        for column in columns:
            texts = column.fillna("").tolist()
            group = np.cumsum([0, *map(len, texts)])[:-1] // batch_chars
            tokens = np.zeros(len(texts), np.int64)
            for g in np.unique(group):
                own = np.flatnonzero(group == g)
                tokens[own] = machine.counts([texts[k] for k in own])
            yield pd.DataFrame({"n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": tokens})

    count = F.pandas_udf(counted, "n_bytes long, n_tokens long")
    out = docs.select("doc_id", count("text").alias("_counted")).select("doc_id", "_counted.*")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
