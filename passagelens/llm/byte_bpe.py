"""Byte-level BPE, encoding and decoding, from a file of ranks; long texts are encoded in overlapping chunks.

Texts of at most `chunk` characters are cut into pieces by the split pattern and encoded where they are. A longer one becomes a row
a chunk, and its chunks go to tasks of their own. Each chunk reaches `overlap` characters into the next and is cut into
pieces from its first character on, wherever that lies. Two neighbours have found their common pieces at the first place in the overlap where both
begin a piece: what a scan finds from there on follows from the text behind that place alone. A chunk's pieces from its own such place up to the
next chunk's are then encoded, and a text's ids are put together in the order of its chunks. Where an overlap holds no common
place (a run of one class of characters that is longer than the overlap), the text is cut anew from the chunk before it on, as one.
Texts that occur several times are encoded once, if they are long.

A piece is encoded by merging its adjacent parts of least rank, the leftmost of equal ones; short pieces of one length are merged side by side. Decoding is the ids' bytes one after another.

Defined results: null counts as the empty text, which has no ids; rows that repeat a doc_id, or have none, are encoded one by one; an empty
table gives an empty table; columns besides doc_id and text are ignored, whatever their names. Ids that no token has make decode() fail.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Characters of a chunk and of what it shares with the next. Piece ends in the last MARGIN characters of a chunk that is cut off may be wrong.
CHUNK, OVERLAP, MARGIN = 65_536, 2_048, 16
#: So many pieces are remembered with their ids, about 130 MB; texts are taken by so many characters at a time; longer pieces are merged one by one, by a heap.
REMEMBERED, AT_ONCE, SHORT = 600_000, 1_000_000, 64
NEVER = 1 << 62


class Encoder:
    """Ranks as a map from bytes to ids, and the other way round. Ids are packed as little-endian 32-bit numbers."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)])
        made = {(self.ranks[t[:i]], self.ranks[t[i:]]): rank for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        keys = np.array([a * len(self.tokens) + b for a, b in made], np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_ranks = keys[order], np.array(list(made.values()), np.int64)[order]
        self.known: dict[str, bytes] = {}

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens put together, NEVER where that is no token."""
        key = a.astype(np.int64) * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NEVER)

    def _merged_few(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Pieces of one length, side by side: a round merges a pair of each piece that has one left. Gives each piece and its packed ids."""
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)].reshape(len(pieces), -1)
        own = np.arange(len(pieces))
        rank = self._ranks_of(ids[:, :-1], ids[:, 1:])
        while len(own):
            rows, width = np.arange(len(own)), ids.shape[1]
            at = rank.argmin(axis=1) if width > 1 else rows
            best = rank[rows, at] if width > 1 else np.full(len(own), NEVER)
            left = best != NEVER
            packed = ids[~left].astype("<u4").tobytes()
            for k, i in enumerate(own[~left].tolist()):
                yield pieces[i], packed[4 * width * k : 4 * width * (k + 1)]
            own, ids, rank, at, best = (x[left] for x in (own, ids, rank, at, best))
            if not len(own):
                return
            rows, place = np.arange(len(own)), np.arange(width - 1)
            ids[rows, at] = best
            ids = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
            rank = np.take_along_axis(rank, place[:-1] + (place[:-1] >= at[:, None]), axis=1)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            rank[before, at[before] - 1] = self._ranks_of(ids[before, at[before] - 1], ids[before, at[before]])
            rank[after, at[after]] = self._ranks_of(ids[after, at[after]], ids[after, at[after] + 1])

    def merged(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each distinct piece and its packed ids."""
        by_size: dict[int, list[bytes]] = {}
        for piece in pieces:
            if piece in self.ranks:
                yield piece, np.array([self.ranks[piece]], "<u4").tobytes()
            elif len(piece) > SHORT:
                yield piece, np.array(self._merged_many(piece), "<u4").tobytes()
            else:
                by_size.setdefault(len(piece), []).append(piece)
        for same in by_size.values():
            yield from self._merged_few(same)

    def _merged_many(self, data: bytes) -> list[int]:
        """The ids of one long piece: pairs wait in a heap by rank and place."""
        n, ranks = len(data), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [ranks.get(data[i : i + 2]) for i in range(n - 1)] + [None]  # the rank of the part that begins here with the next one
        heap = [(rank, i) for i, rank in enumerate(pair) if rank is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if pair[i] != rank:
                continue  # has changed since
            gone = after[i]
            after[i], pair[gone] = after[gone], None
            end = after[i]
            if end < n:
                before[end] = i
                pair[i] = ranks.get(data[i : after[end]])
                if pair[i] is not None:
                    heapq.heappush(heap, (pair[i], i))
            else:
                pair[i] = None
            if (p := before[i]) >= 0:
                pair[p] = ranks.get(data[p:end])
                if pair[p] is not None:
                    heapq.heappush(heap, (pair[p], p))
        ids, at = [], 0
        while at < n:
            ids.append(ranks[data[at : after[at]]])
            at = after[at]
        return ids

    def put_together(self, split: list[list[str]]) -> list[bytes]:
        """The packed ids of texts that are split into pieces; a piece's are found once and remembered."""
        found = [list(map(self.known.get, pieces)) for pieces in split]
        new = {p for pieces, ids in zip(split, found) if None in ids for p, x in zip(pieces, ids) if x is None}
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new, found = {p for pieces in split for p in pieces}, [[None]] * len(split)
        names = {p.encode("utf-8"): p for p in new}
        for piece, ids in self.merged(list(names)):
            self.known[names[piece]] = ids
        get = self.known.__getitem__
        return [b"".join(map(get, pieces) if None in ids else ids) for pieces, ids in zip(split, found)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Texts are split, and their new pieces encoded, by about AT_ONCE characters."""
        group = np.cumsum([0, *map(len, texts)])[:-1] // AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(texts)] if texts else []
        return [ids for a, b in zip(cuts, cuts[1:]) for ids in self.put_together([self.pattern.findall(t) for t in texts[a:b]])]

    def ends(self, text: str) -> list[int]:
        """Where the pieces of a text end."""
        return [m.end() for m in self.pattern.finditer(text)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def _encoder(ranks: str, pattern: str | None) -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path(ranks), pattern or public_tokenizers.PATTERN)


def _long_texts(texts: DataFrame, ranks: str, pattern: str | None, chunk: int, overlap: int) -> DataFrame:
    """key, ids of texts (key, text) of more than chunk characters."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, text in zip(frame.key, frame.text):
                begin = range(0, len(text), chunk)
                yield pd.DataFrame({"key": key, "at": np.arange(len(begin)), "cut": [len(text) > b + chunk + overlap for b in begin], "part": [text[b : b + chunk + overlap] for b in begin]})

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(ranks, pattern)
        for frame in frames:
            ends = [encoder.ends(part) for part in frame.part]
            heads = [[0, *(e for e in own if e < overlap)] for own in ends]
            sure = lambda own, part, is_cut: [e for e in own[:-1] if e <= len(part) - MARGIN] if is_cut else own
            tails = [[e - chunk for e in sure(own, part, is_cut) if e >= chunk] for own, part, is_cut in zip(ends, frame.part, frame.cut)]
            yield frame.drop(columns="cut").assign(ends=ends, heads=heads, tails=tails)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(ranks, pattern)
        for frame in frames:
            out = []
            for parts, start, stop in zip(frame.parts, frame.start, frame.stop):
                if len(parts) == 1:
                    text, ends = parts[0]["part"], [e for e in parts[0]["ends"] if e > start]
                else:
                    text = "".join([p["part"][:chunk] for p in parts[:-1]] + [parts[-1]["part"]])
                    ends = [start + e for e in encoder.ends(text[start:])]
                ends = [e for e in ends if e <= stop] if stop >= 0 else ends
                out += encoder.put_together([[text[a:b] for a, b in zip([start, *ends[:-1]], ends)]])
            yield pd.DataFrame({"key": frame.key, "segment": frame.segment, "ids": out})

    parallel = max(texts.sparkSession.sparkContext.defaultParallelism, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = texts.mapInPandas(cut, "key string, at long, cut boolean, part string").repartition(parallel, "key", "at")
    scanned = rows.mapInPandas(scan, "key string, at long, part string, ends array<int>, heads array<int>, tails array<int>")
    by_text = Window.partitionBy("key").orderBy("at")
    met = F.when(F.col("at") == 0, 0).otherwise(F.array_min(F.array_intersect("heads", F.lag("tails").over(by_text))))
    begun = scanned.withColumn("start", met).drop("heads", "tails")
    lost = F.min(F.when(F.col("start").isNull(), F.col("at"))).over(Window.partitionBy("key"))
    placed = begun.withColumns({"next": F.lead("start").over(by_text), "lost": lost}).withColumn("segment", F.coalesce(F.least("at", F.col("lost") - 1), F.col("at")))
    stop = F.when(F.col("lost").isNull() | (F.col("at") < F.col("lost") - 1), F.col("next") + chunk)  # where the next segment begins; null: at the end of the text
    one = F.struct("at", "part", "ends", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce(stop, F.lit(-1)).alias("stop"))
    parts = placed.select("key", "segment", one.alias("one")).repartition(parallel, "key", "segment").groupBy("key", "segment").agg(F.array_sort(F.collect_list("one")).alias("parts"))
    segments = parts.select("key", "segment", "parts", F.col("parts")[0]["start"].alias("start"), F.element_at("parts", -1)["stop"].alias("stop"))
    ids = segments.mapInPandas(encode, "key string, segment long, ids binary")
    joined = F.pandas_udf(lambda column: pd.Series([b"".join(own) for own in column]), "binary")
    listed = ids.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("segment", "ids"))).alias("own"))
    return listed.select("key", joined(F.transform("own", lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, with_decoded: bool = False) -> DataFrame:
    """doc_id, ids (packed little-endian 32-bit numbers). ranks: a rank file's name; pattern: the library's own if not given. with_decoded adds
    what decode() makes of the ids, in the same workers."""
    if not MARGIN < overlap <= chunk:
        raise ValueError("an overlap is shorter than a chunk and longer than MARGIN")

    def whole(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(ranks, pattern)
        for column in columns:
            ids = encoder.encode(column.tolist())
            yield pd.DataFrame({"ids": ids} | ({"decoded": [encoder.decode(own) for own in ids]} if with_decoded else {}))

    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = docs.where(F.length("text") <= chunk).select("doc_id", F.pandas_udf(whole, "ids binary, decoded binary" if with_decoded else "ids binary")("text").alias("_done")).select("doc_id", "_done.*")
    long = settled(docs.where(F.length("text") > chunk).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"), "text"))
    if long.isEmpty():
        return short
    done = settled(_long_texts(long.groupBy("key").agg(F.first("text").alias("text")), ranks, pattern, chunk, overlap))
    done = decode(done, ranks, pattern) if with_decoded else done
    return short.unionByName(long.select("doc_id", "key").join(done, "key").drop("key"))


def decode(encoded: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """encoded with `decoded`: the bytes that its ids stand for."""

    def back(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(ranks, pattern)
        for column in columns:
            yield pd.Series([encoder.decode(ids) for ids in column])

    return encoded.withColumn("decoded", F.pandas_udf(back, "binary")("ids"))
