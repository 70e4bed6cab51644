"""Language identification by prediction by partial matching.

For each language a variable-order tree of byte contexts is counted on a bounded sample
and then frozen. A byte's code length is exact under those counts: from the longest
context seen it is either coded there, or an escape is coded and the next shorter
context tried, down to a uniform byte (escape by method C, without exclusion). The
language whose tree codes the whole text in the fewest bits is predicted.

A code length depends only on a byte and the four before it, so the lengths of every
five-byte string of the sample are worked out once, and a text is a table lookup per
byte; strings outside the table are worked out as they come, each once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import table, tidy
from meridian.llm.words import ODD, mix, normal, packs

PACK_BYTES = 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class Plan:
    """order: bytes of the longest context (at most 7); sample_bytes: text that all trees together are counted on;
    longest: characters of the text that stands in for a language which the sample would leave out."""

    order: int = 4
    sample_bytes: int = 3 << 20
    longest: int = 1 << 16
    seed: int = 42


def prepared(text: str | None) -> bytes:
    """What is coded: the lower-cased words, each with a space before it."""
    return b" " + normal((text or "").lower().encode("utf-8", "replace"))


def grams(lines: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The last order + 1 bytes up to each byte of each text, as a number, and the text's first byte's place.

    Before its first byte a text has zero bytes, which no text holds.
    """
    gap = b"\0" * order
    a = np.frombuffer(gap + gap.join(lines), np.uint8)
    keep = np.ones(len(a), bool)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = order + np.cumsum(size + order) - order
    for k in range(order):
        keep[np.concatenate([[k], ends[:-1] + k])] = False
    out = np.zeros(len(a) - order, np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | a[k : k + len(out)]
    return out[keep[order:]], np.cumsum(size) - size


class Trees:
    """Frozen statistics of all languages, and code lengths under them."""

    def __init__(self, texts: dict[str, list[str]], plan: Plan):
        self.langs = sorted(texts)
        self.order = plan.order
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []  # by context length: strings, bits when coded there
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []  # by context length: contexts, bits of an escape
        every = {lang: grams([prepared(t) for t in texts[lang]], plan.order)[0] for lang in self.langs}
        for k in range(plan.order + 1):
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            found = {lang: np.unique(g & mask, return_counts=True) for lang, g in every.items()}
            keys = np.unique(np.concatenate([s for s, _ in found.values()])) if found else np.empty(0, np.uint64)
            ctx = np.unique(keys >> np.uint64(8))
            coded = np.full((len(keys), len(self.langs)), np.nan, np.float32)
            escape = np.zeros((len(ctx), len(self.langs)), np.float32)
            for j, lang in enumerate(self.langs):
                s, n = found[lang]
                c, of = np.unique(s >> np.uint64(8), return_inverse=True)
                total, kinds = np.bincount(of, n), np.bincount(of)
                coded[np.searchsorted(keys, s), j] = np.log2((total + kinds)[of] / n)
                escape[np.searchsorted(ctx, c), j] = np.log2((total + kinds) / kinds)
            self.seen.append((keys, coded))
            self.contexts.append((ctx, escape))
        known = self.seen[-1][0]
        self.known, self.bits = known, self.lengths(known)
        self.size = max(12, int(len(known) * 4).bit_length())
        self.slots = np.full(1 << self.size, -1, np.int32)
        self.slots[self._slot(known)[::-1]] = np.arange(len(known), dtype=np.int32)[::-1]

    def _slot(self, strings: np.ndarray) -> np.ndarray:
        return ((strings * ODD) >> np.uint64(64 - self.size)).astype(np.int64)

    def lengths(self, strings: np.ndarray) -> np.ndarray:
        """Code length in bits of each string's last byte, by language."""
        bits = np.zeros((len(strings), len(self.langs)), np.float32)
        open_ = np.ones(bits.shape, bool)
        for k in range(self.order, -1, -1):
            part = strings & np.uint64((1 << (8 * (k + 1))) - 1)
            for (keys, values), wanted, final in ((self.seen[k], part, True), (self.contexts[k], part >> np.uint64(8), False)):
                if not len(keys):
                    continue
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                add = np.where((keys[at] == wanted)[:, None], values[at], np.nan if final else 0)
                here = open_ & ~np.isnan(add)
                bits[here] += add[here]
                if final:
                    open_ &= ~here
        bits[open_] += 8
        return bits

    def totals(self, lines: list[bytes]) -> np.ndarray:
        """Code length of each text, by language."""
        strings, starts = grams(lines, self.order)
        at = self.slots[self._slot(strings)]
        miss = np.flatnonzero((at < 0) | (self.known[at] != strings)) if len(self.known) else np.arange(len(strings))
        out = np.empty((len(strings), len(self.langs)), np.float32)
        if len(self.known):
            np.take(self.bits, at, axis=0, out=out, mode="clip")
        if len(miss):
            new, which = np.unique(strings[miss], return_inverse=True)
            out[miss] = self.lengths(new)[which]
        return np.add.reduceat(out, starts, axis=0, dtype=np.float64)


def learned(docs: DataFrame, usable, plan: Plan = Plan()) -> Trees:
    """Trees from a bounded sample of the usable rows with a language, about equally many bytes a language.

    The sample is drawn by a hash of doc_id and text. Every language with a text is learned: where the draw
    leaves one short, its first document by that hash is added. A text gives as many characters at most as its
    language is to have bytes. Null and empty texts teach nothing.
    """
    named = docs.filter(usable & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    draw = F.xxhash64(F.lit(plan.seed), "doc_id", "text")
    head = F.substring("text", 1, plan.longest)
    sizes = named.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"), F.min_by(head, draw).alias("first")).collect()
    texts: dict[str, list[str]] = {}
    if sizes:
        each = max(1, plan.sample_bytes // len(sizes))
        share = F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(int(min(1.0, each / r.n) * (1 << 30))))])
        left = dict.fromkeys((r.lang for r in sizes), 2 * each)  # a bound, whatever the draw
        some = named.filter(F.pmod(draw, F.lit(1 << 30)) < F.element_at(share, F.col("lang")))
        some = some.select("lang", F.substring("text", 1, each).alias("text")).orderBy("lang", F.xxhash64("text"))
        for r in some.toLocalIterator():
            if left[r.lang] > 0:
                texts.setdefault(r.lang, []).append(r.text)
                left[r.lang] -= len(r.text.encode())
        for r in sizes:
            if 2 * each - left[r.lang] < min(each, r.n) // 2:
                texts.setdefault(r.lang, []).append(r.first[:each])
    return Trees(texts, plan)


def identified(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) for every row, from its text alone.

    lang_pred is the language with the shortest code, ties to the first by name; ``und`` with score 0 for a
    text that is null or holds no letter, or where nothing was learned. score is the language's share of
    probability among all, a byte's length each, so long texts do not all round to 1. Repeated rows are each
    answered; an empty table gives no rows. Only doc_id and text are looked at.
    """
    rows = docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = not trees.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            pred, score, rate = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            lettered = ((prepared(t), i) for i, t in enumerate(texts) if t is not None and not none)
            for pack in packs(lettered, PACK_BYTES):
                lines = [x for x, _ in pack]
                bits = trees.totals(lines)
                best = np.argmin(bits, axis=1)
                per = bits / np.array([len(x) for x in lines])[:, None]
                share = 1 / np.exp2(per.min(axis=1, keepdims=True) - per).sum(axis=1)
                for (_, i), j, s, r in zip(pack, best.tolist(), share.tolist(), per.min(axis=1).tolist(), strict=True):
                    pred[i], score[i], rate[i] = trees.langs[j], s, r
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    out = identified(docs, learned(docs, fold != 2))
    return out.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")
