"""SentencePiece BPE encoding with seeded merge-dropout, and its lossless decoding.

Encoding keeps an agenda of candidate merges, best first. A candidate that comes up is
skipped for good with probability ``dropout``, by a hash of the seed, the document, the
word's place in it and the candidate; what remains merged is the segmentation. So every
place draws its own segmentation, and reruns agree.

A word's agenda without dropout is worked through once and its merges are kept. At a
place where no such merge is skipped the segmentation is the kept one; at the others the
agenda is worked through for that place, all such places of a batch together, as arrays:
in each round every word's best candidate comes up.

No piece has a space mark after another character, so a text falls into words that
never merge with each other; that is checked when a vocabulary is loaded. Characters
without a piece, and the space mark itself where a text holds it, become byte pieces,
so decoding gives back every text exactly.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import table, tidy
from meridian.llm.words import ODD, ODD2, mix, packs

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a space mark that the text itself holds; no piece starts with it.
HELD_MARK = "\0" + MARK
PACK_CHARS = 1 << 19
#: Characters of the longest word whose agenda is worked through together with others.
LONG = 64
BATCH_TOKENS = 1_000_000
#: log2 of the slots of a table of merges.
SLOT_BITS = 18
#: Words whose agendas are worked through together.
TOGETHER = 20_000


@dataclass(frozen=True)
class Plan:
    """dropout: probability that a candidate merge is skipped; kept: words whose agenda without dropout a process
    keeps before it starts anew (this bounds memory and changes no result)."""

    dropout: float = 0.1
    seed: int = 42
    kept: int = 60_000


class Vocabulary:
    """Pieces with their merge ranks and bytes; read on the driver and broadcast (some 15 MB of tables)."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte = [0] * 256
        raw: list[bytes] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                raw.append(b"")
            else:
                self.rank[piece] = (-model.get_score(i), i)
                raw.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece has a space mark after another character")
        joined = set("".join(p for p in self.rank if len(p) > 1))
        apart = "".join(c for c in "\n\t\r\x0b\x0c" if c not in joined)
        gap = re.escape(apart) if apart else ""
        self.pattern = f" *[^ {gap}]+| +" + (f"|[{gap}]" if gap else "")
        sizes = np.array([len(r) for r in raw], np.int64)
        self.sizes, self.places = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self._tables()

    def _tables(self) -> None:
        """Arrays for many words at once: symbols of characters, merges of symbol pairs, places in the agenda."""
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)  # a character without a piece is minus itself, less 1
        for piece, (_, i) in self.rank.items():
            if len(piece) == 1 and piece != MARK:
                self.symbol[ord(piece)] = i
        self.symbol[ord(" ")] = self.rank[MARK][1]
        merges = {}
        for piece, (_, i) in self.rank.items():
            for cut in range(1, len(piece)):
                left, right = self.rank.get(piece[:cut]), self.rank.get(piece[cut:])
                if left and right:
                    merges[left[1] << 32 | right[1]] = i
        # pair -> merged piece: each pair is in the first of a few hash tables that had room for it
        keys, made = np.array(list(merges), np.uint64), np.array(list(merges.values()), np.int32)
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        odd = int(ODD)
        while len(keys):
            slot = ((keys * np.uint64(odd)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            held, value = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int32)
            held[slot], value[slot] = keys, made
            self.tables.append((np.uint64(odd), held, value))
            out = held[slot] != keys
            keys, made, odd = keys[out], made[out], (odd * 0xBF58476D1CE4E5B9 + 2) & 0xFFFFFFFFFFFFFFFF | 1
        costs = sorted({c for c, _ in self.rank.values()})
        order = {c: k for k, c in enumerate(costs)}
        self.order = np.zeros(len(self.sizes), np.int64)
        for c, i in self.rank.values():
            self.order[i] = order[c]

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        keys = (left.astype(np.int64) << 32 | right).view(np.uint64)
        out = np.full(len(keys), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for odd, held, value in self.tables:
            slot = ((keys[todo] * odd) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            hit = held[slot] == keys[todo]
            out[todo[hit]] = value[slot[hit]]
            todo = todo[~hit & (value[slot] >= 0)]
        return out

    def segment_all(self, words: list[str], keys: np.ndarray, limit: int, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of many non-empty words, one after the other; word for word what segmented() gives.

        merges, if given, receives (word numbers, candidate codes) of the merges made, round by round.
        """
        none = np.int64(1 << 38)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(len(symbols)) - np.repeat(starts, sizes)

        def candidates(left, right, key, place):
            piece = self.merged(left, right)
            rank = self.order[piece]
            gone = piece < 0
            if limit:
                gone |= skipped(key, code(piece, place), limit)
            return piece, np.where(gone, none, rank)

        last = starts + sizes - 1
        piece, rank = np.full(len(symbols), -1, np.int32), np.full(len(symbols), none)
        inner = np.ones(len(symbols), bool)
        inner[last] = False
        inner = np.flatnonzero(inner)
        piece[inner], rank[inner] = candidates(symbols[inner], symbols[inner + 1], np.repeat(keys, sizes)[inner], at[inner])
        done_words: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number = np.arange(len(words))
        while len(number):
            best = np.minimum.reduceat(rank << 24 | np.arange(len(rank)), starts)
            done = best >= none << 24
            if done.any():
                which = np.flatnonzero(done)
                done_words.append((number[which], symbols[np.repeat(done, sizes)], sizes[which]))
                live = ~done
                keep = ~np.repeat(done, sizes)
                moved = np.cumsum(keep) - 1
                symbols, at, piece, rank = symbols[keep], at[keep], piece[keep], rank[keep]
                number, keys, sizes = number[live], keys[live], sizes[live]
                hit = moved[best[live] & 0xFFFFFF]
                starts = np.cumsum(sizes) - sizes
                if not len(number):
                    break
            else:
                hit = best & 0xFFFFFF
            if merges is not None:
                merges.append((number, code(piece[hit], at[hit])))
            symbols[hit] = piece[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, at, piece, rank = symbols[keep], at[keep], piece[keep], rank[keep]
            hit = hit - np.arange(len(hit))  # each word before has lost one symbol
            sizes = sizes - 1
            starts = np.cumsum(sizes) - sizes
            ends = starts + sizes - 1
            piece[hit], rank[hit] = -1, none
            more = hit < ends
            piece[hit[more]], rank[hit[more]] = candidates(symbols[hit[more]], symbols[hit[more] + 1], keys[more], at[hit[more]])
            less = hit > starts
            piece[hit[less] - 1], rank[hit[less] - 1] = candidates(symbols[hit[less] - 1], symbols[hit[less]], keys[less], at[hit[less] - 1])
        if not done_words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        number, flat, sizes = (np.concatenate(x) for x in zip(*done_words, strict=True))
        order = np.argsort(number)
        flat, sizes = flat[ragged((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]
        return self._spelled_out(flat, sizes)

    def _spelled_out(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words of symbols: characters without a piece become bytes."""
        odd = np.flatnonzero(flat < 0)
        if not len(odd):
            return flat, sizes
        raw = [chr(-1 - s).encode() for s in flat[odd].tolist()]
        wide = np.ones(len(flat), np.int64)
        wide[odd] = [len(r) for r in raw]
        ends = np.concatenate([[0], np.cumsum(wide)])
        ids = np.repeat(flat, wide)
        ids[ragged(ends[odd], wide[odd])] = np.array(self.byte, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
        upto = ends[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(upto)

    def spelled(self, symbol: str) -> list[int]:
        """Byte pieces of a symbol without a piece."""
        return [self.byte[b] for b in (MARK if symbol == HELD_MARK else symbol).encode()]

    def segmented(self, word: str, key: int, limit: int) -> list[int]:
        """Ids of a word, spaces first; candidates are skipped where their hash under key is below limit (of 2^32)."""
        symbols: list[str | None] = [HELD_MARK if c == MARK else MARK if c == " " else c for c in word] if MARK in word else list(word.replace(" ", MARK))
        rank = self.rank
        n = len(symbols)
        agenda = []
        for i in range(n - 1):
            if (r := rank.get(symbols[i] + symbols[i + 1])) is not None:
                agenda.append((r[0], i, i + 1, symbols[i] + symbols[i + 1], r[1]))
        if agenda:
            heapq.heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                _, i, j, piece, number = heapq.heappop(agenda)
                if symbols[i] is None or symbols[j] is None or symbols[i] + symbols[j] != piece:
                    continue
                if limit:
                    h = (key ^ (number * 0x9E3779B97F4A7C15 + i * 0xC2B2AE3D27D4EB4F)) & 0xFFFFFFFFFFFFFFFF
                    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
                    if h >> 32 < limit:
                        continue
                symbols[i], symbols[j] = piece, None
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (r := rank.get(piece + symbols[k])) is not None:
                        heapq.heappush(agenda, (r[0], i, k, piece + symbols[k], r[1]))
                if (h := before[i]) >= 0 and (r := rank.get(symbols[h] + piece)) is not None:
                    heapq.heappush(agenda, (r[0], h, i, symbols[h] + piece, r[1]))
        out: list[int] = []
        for s in symbols:
            if s is not None:
                r = rank.get(s)
                if r is not None:
                    out.append(r[1])
                else:
                    out += self.spelled(s)
        return out


def code(piece: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A candidate merge, as it is hashed: the piece it makes and the place of its first character in the word."""
    return piece.astype(np.uint64) * ODD + place.astype(np.uint64) * ODD2


def skipped(key: np.ndarray, codes: np.ndarray, limit: int) -> np.ndarray:
    """Whether candidates are skipped under the keys of their words' places; limit is of 2^32."""
    h = key ^ codes
    return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)) < limit


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... of each run of sizes[i], one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Runs:
    """Runs of values that are appended to and looked up by number."""

    def __init__(self, kind):
        self.values, self.starts, self.sizes = np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes) - sizes])
        self.values, self.sizes = np.concatenate([self.values, values]), np.concatenate([self.sizes, sizes])


class Encoder:
    def __init__(self, vocabulary: Vocabulary, plan: Plan):
        self.v, self.plan = vocabulary, plan
        self.find = re.compile(vocabulary.pattern).findall
        self.limit = int(plan.dropout * (1 << 32))
        self._anew()

    def _anew(self) -> None:
        """Keep no words."""
        self.number: dict[str, int] = {}
        self.ids, self.merges = Runs(np.int32), Runs(np.uint64)  # of each word without dropout

    def _learn(self, words: list[str]) -> None:
        """Segmentations without dropout of words that follow those in ids and merges; long ones are left empty."""
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            short = np.fromiter((len(w) <= LONG for w in part), bool, len(part))
            some = [w for w in part if len(w) <= LONG]
            rounds: list[tuple[np.ndarray, np.ndarray]] = []
            ids, sizes = self.v.segment_all(some, np.zeros(len(some), np.uint64), 0, rounds) if some else (np.empty(0, np.int32), np.empty(0, np.int64))
            number = np.concatenate([n for n, _ in rounds] or [np.empty(0, np.int64)])
            codes = np.concatenate([c for _, c in rounds] or [np.empty(0, np.uint64)])
            n_ids, n_merges = np.zeros((2, len(part)), np.int64)
            n_ids[short], n_merges[short] = sizes, np.bincount(number, minlength=len(some))
            self.ids.append(ids, n_ids)
            self.merges.append(codes[np.argsort(number, kind="stable")], n_merges)

    def _drawn(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words at places where some merge is skipped, and of long words."""
        made = Runs(np.int32)
        for at in range(0, len(words), TOGETHER):
            part, key = words[at : at + TOGETHER], keys[at : at + TOGETHER]
            short = np.fromiter((len(w) <= LONG for w in part), bool, len(part))
            if short.all():
                made.append(*self.v.segment_all(part, key, self.limit))
                continue
            # a round costs a word's length, so long words have an agenda of their own
            for w, k, ok in zip(part, key.tolist(), short.tolist(), strict=True):
                ids = self.v.segment_all([w], np.array([k], np.uint64), self.limit)[0] if ok else np.array(self.v.segmented(w, k, self.limit), np.int32)
                made.append(ids, np.array([len(ids)]))
        return made.values, made.sizes

    def encode_all(self, rows: list[tuple[str, int]]) -> list[np.ndarray]:
        """Ids of some texts, given with their documents' numbers."""
        if len(self.number) >= self.plan.kept:
            self._anew()
        number, words, keys, count = self.number, [], [], []
        for text, doc in rows:
            found = self.find(" " + text) if text else []
            start = np.uint64((doc * 2 + self.plan.seed) & 0xFFFFFFFFFFFFFFFF)
            keys.append(mix(mix(np.arange(len(found), dtype=np.uint64) * ODD + start) + start))
            count.append(len(found))
            words += found
        known = len(number)
        for w in words:
            if w not in number:
                number[w] = len(number)
        if len(number) > known:
            self._learn(list(number)[known:])
        at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        key = np.concatenate(keys or [np.empty(0, np.uint64)])
        starts, sizes = self.ids.starts[at], self.ids.sizes[at]
        again = sizes == 0  # long words
        if self.limit:
            n = self.merges.sizes[at]
            hits = skipped(np.repeat(key, n), self.merges.values[ragged(self.merges.starts[at], n)], self.limit)
            upto = np.concatenate([[0], np.cumsum(hits)])
            ends = np.cumsum(n)
            again |= upto[ends] > upto[ends - n]
        some = np.flatnonzero(again)
        ids, more = self._drawn([words[i] for i in some.tolist()], key[some])
        starts[some], sizes[some] = len(self.ids.values) + np.cumsum(more) - more, more
        flat = np.concatenate([self.ids.values, ids])[ragged(starts, sizes)]
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(count)])]
        return [flat[lo:hi] for lo, hi in zip(edges.tolist(), edges[1:].tolist(), strict=False)]

    def encode(self, text: str, doc: int) -> np.ndarray:
        """Ids of a text."""
        return self.encode_all([(text, doc)])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids were made from."""
        if not len(ids):
            return ""
        v = self.v
        sizes = v.sizes[ids]
        ends = np.cumsum(sizes)
        raw = v.bytes[np.repeat(v.places[ids] - ends + sizes, sizes) + np.arange(ends[-1])]
        return raw[1:].tobytes().decode("utf-8", "replace")


_ENCODERS: dict = {}


def _encoder(vocabulary, plan: Plan, name: str) -> Encoder:
    """One encoder a process for each vocabulary (a broadcast) and plan, so that its words stay known from task to task."""
    key = (name, plan)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary.value, plan)
    return _ENCODERS[key]


def _document(ident) -> int:
    """The number that a document's segmentations are drawn by."""
    return 0 if ident is None else ident if isinstance(ident, int) else xxhash.xxh64_intdigest(str(ident).encode())


def encoded(docs: DataFrame, path: str = MODEL, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, ids, n_tokens, lossless) for every row; lossless: decoding ids gave the text back.

    A null text has null ids, no tokens, and counts as lossless; an empty one has no ids. Equal rows are
    segmented alike. A null doc_id draws as number 0, one that is no number by its text's hash. An empty table
    gives no rows. Only doc_id and text are looked at.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "ids", "n_tokens", "lossless"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(vocabulary, plan, path)
        for b in batches:
            first, made, same = 0, [], []

            def out(upto, first=0, made=(), same=()):
                n = [0 if x is None else len(x) for x in made]
                flat = np.concatenate([x for x in made if x is not None] or [np.empty(0, np.int32)])
                ends = np.concatenate([[0], np.cumsum(n)])
                gone = pa.array([x is None for x in made] + [False])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.asarray(gone)), pa.array(flat, pa.int32()))
                return pa.RecordBatch.from_arrays([b.column(0).slice(first, upto - first), lists, pa.array(n, pa.int64()), pa.array(same)], names)

            held = 0
            rows = ((t.as_py(), _document(d)) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True))
            for pack in packs(rows, PACK_CHARS, lambda row: len(row[0] or "")):
                for (text, _), ids in zip(pack, coder.encode_all([(t or "", d) for t, d in pack]), strict=True):
                    made.append(None if text is None else ids)
                    same.append(text is None or coder.decode(ids) == text)
                    held += len(ids)
                if held >= BATCH_TOKENS:
                    upto = first + len(made)
                    yield out(upto, first, made, same)
                    first, made, same, held = upto, [], [], 0
            if made:
                yield out(b.num_rows, first, made, same)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>, n_tokens long, lossless boolean")


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """rows (doc_id, ids) as (doc_id, text); null ids give a null text, no ids an empty one.

    Repeated rows are each decoded; an empty table gives no rows. Only doc_id and ids are looked at.
    """
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary(path))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(vocabulary.value, Plan())
        for b in batches:
            texts = [None if x.as_py() is None else coder.decode(x.values.to_numpy(zero_copy_only=False).astype(np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(tidy(run), f"doc_id {kind}, text string")


def op2_pieces(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"))
