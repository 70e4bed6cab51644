"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers. The field
then labels each document's candidate words with a kind or none. Candidates are the words
with a digit or an at sign, and those that are the mailbox of an address in the document;
no other word can be part of these kinds. Neighbouring candidates share a chain potential.
Candidates that are alike however far apart (the same text, the same last seven digits, the
last four digits of a match, the same network, the same mailbox) share a skip potential,
each linked to the next such one, so links grow with the text only. Words inside pattern
matches keep those labels; loopy message passing carries them along both kinds of links,
and what is then labelled surely enough is added, so a number that was found once in full
is also found where it is repeated in part.

The field is trained by pseudo-likelihood on a bounded sample of documents with the
patterns as labels. Texts rarely say which partial mentions are personal data, so mentions
are held out for it: a part of a match is put elsewhere in its document and bears the
match's label; a part of another document's match is put there too and bears none. The two
look the same, so only the links can tell them apart. A word of the text itself that is
linked to a match without being one counts as unlabelled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import table, tidy

# Kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")

_SIGN = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin at the start of a run of digits, as the run's other starts end the same way.
_DOTTED = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NET = re.compile(r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?:\.[0-9x*]+)?")
_EDGE = "\"'()[]{}<>,;:!?.#*$%&|="


@dataclass(frozen=True)
class Plan:
    """sample_bytes: text the field is trained on, longest: bytes of a text in that sample; bits: log2 of the hashed
    features; rounds: of message passing; sure: the probability from which a label is added."""

    sample_bytes: int = 4 << 20
    longest: int = 1 << 20
    bits: int = 12
    steps: int = 400
    rounds: int = 12
    sure: float = 0.8
    seed: int = 42


# ---- patterns


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _bare(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def matched(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the patterns, by kind: leftmost, not overlapping within a kind, failing ones dropped."""
    emails, floor = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                emails.append((start, m.end()))
                floor = m.end()
    ips = [m.span() for m in _DOTTED.finditer(text) if all(map(_octet, m.groups()))]
    cards = [m.span() for m in _DIGITS.finditer(text) if 13 <= len(d := _bare(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in _PLUS.finditer(text) if 9 <= len(_bare(m[0])) <= 15] if "+" in text else []
    return [emails, ips, cards, phones]


# ---- the field


class Graph:
    """Candidate words of a document: spans, features, links, and the patterns' labels (0: none).

    held: (start, end, label) of words whose label is known without a pattern, for training.
    """

    def __init__(self, text: str, spans: list[list[tuple[int, int]]], bits: int, held: Sequence[tuple[int, int, int]] = ()):
        boxes = {box for a, b in spans[0] if _telling(box := text[a:b].partition("@")[0].lower())}
        words, places = [], []
        for k, m in enumerate(_WORD.finditer(text)):
            if (sign := _SIGN.search(m[0])) or boxes:
                core = m[0].strip(_EDGE)
                if sign or core.lower() in boxes:
                    lo = m.start() + m[0].find(core) if core else m.start()
                    words.append((lo, lo + len(core) if core else m.end(), core or m[0]))
                    places.append(k)
        self.spans = [(a, b) for a, b, _ in words]
        n = len(words)
        self.label = np.zeros(n, np.int64)
        self.held = np.zeros(n, bool)
        starts = np.array([a for a, _, _ in words], np.int64)
        ends = np.array([b for _, b, _ in words], np.int64)
        inside = lambda a, b: slice(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left"))
        numbers: dict[int, str] = {}  # digits of a matched number, by its last word
        for k in reversed(range(len(KINDS))):
            for a, b in spans[k]:
                at = inside(a, b)
                self.label[at] = k + 1
                if k >= 2 and at.stop > at.start:
                    numbers[at.stop - 1] = _bare(text[a:b])
        for a, b, label in held:
            at = inside(a, b)
            self.label[at], self.held[at] = label, True
        shapes = [_shape(w) for _, _, w in words]
        self.features, links, last = [], [], {}
        for i, (_, _, w) in enumerate(words):
            near = i > 0 and places[i] - places[i - 1] <= 1
            ahead = i + 1 < n and places[i + 1] - places[i] <= 1
            if near:
                links.append((i - 1, i, 0))
            for key in _keys(w, numbers.get(i)):
                if key in last and not (near and last[key] == i - 1):
                    links.append((last[key], i, 1))
                last[key] = i
            digits = _bare(w)
            parts = w.split(".")
            named = [
                "shape " + shapes[i],
                f"digits {min(len(digits), 20)}",
                f"length {min(len(w), 40) // 4}",
                f"at {'@' in w} {'.' in w.partition('@')[2]}",
                f"luhn {13 <= len(digits) <= 19 and len(digits) == len(w) and luhn(digits)}",
                f"dotted {len(parts) == 4 and all(p.isdigit() and p.isascii() and _octet(p) for p in parts)}",
                f"plus {w[:1] == '+'}",
                "before " + (shapes[i - 1] if near else "-"),
                "after " + (shapes[i + 1] if ahead else "-"),
            ]
            self.features.append([xxhash.xxh64_intdigest(f.encode(), 1) >> (64 - bits) for f in named])
        self.links = np.array(sorted(set(links)), np.int64).reshape(-1, 3)


def _shape(word: str) -> str:
    out = ""
    for c in word[:64]:
        s = "0" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if out[-2:] != s + s:
            out += s
    return out[:20]


def _telling(box: str) -> bool:
    """Whether a mailbox names somebody by itself: no plain word, as "info" is."""
    return len(box) >= 4 and not box.isalpha() and not box.isdigit()


def _keys(word: str, number: str | None) -> list[str]:
    """What makes distant words alike; number: the digits of the matched number that ends with the word."""
    digits = number or _bare(word)
    found = ["same " + word.lower()] if len(word) >= 5 else []
    if len(digits) >= 7 and (number or len(digits) * 2 >= len(word)):
        found.append("tail " + digits[-7:])
    if number or (len(digits) == 4 and digits == word):
        found.append("last " + digits[-4:])
    if m := _NET.fullmatch(word):
        found.append("net " + m[1])
    box = word.partition("@")[0].lower()
    if _telling(box) and not _NET.fullmatch(word):
        found.append("box " + box)
    return found


def parts_of(kind: int, match: str) -> list[str]:
    """Partial mentions of a match: what a text may repeat of it that no pattern finds."""
    if kind == 0:
        return [match.partition("@")[0]]
    if kind == 1:
        return [match.rpartition(".")[0], match.rpartition(".")[0] + ".x"]
    digits = _bare(match)
    return [digits[-8:], digits[-7:-4] + "-" + digits[-4:], digits[-4:], digits[-10:]]


def with_mentions(text: str, spans: list[list[tuple[int, int]]], foreign: list[tuple[int, str]], seed: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with partial mentions of its own matches and of foreign ones (kind, match), and where they stand:
    (start, end, label), labels of the own ones as of their match, of the foreign ones 0."""
    rng = np.random.default_rng([seed, xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 2)])
    own = [(k, text[a:b]) for k, found in enumerate(spans) for a, b in found]
    chosen = [(k + 1, own[i]) for k in range(len(KINDS)) if (of := [i for i, m in enumerate(own) if m[0] == k]) for i in [of[rng.integers(len(of))]]]
    chosen += [(0, m) for m in foreign]
    taken = np.array(sorted(x for found in spans for x in found), np.int64).reshape(-1, 2)
    gaps = np.array([m.start() for m in re.finditer(r"[\x20\x09-\x0D]", text)], np.int64)
    ends = np.concatenate([[-1], np.maximum.accumulate(taken[:, 1])]) if len(taken) else np.array([-1])
    free = gaps[ends[np.searchsorted(taken[:, 0], gaps, "right")] < gaps].tolist()  # in no match
    if not free:
        return text, []
    put = sorted((free[rng.integers(len(free))], i, label, (f := parts_of(*m))[rng.integers(len(f))]) for i, (label, m) in enumerate(chosen))
    out, held, at, size = [], [], 0, 0
    for gap, _, label, part in put:
        piece = text[at:gap]
        size += len(piece) + 1
        held.append((size, size + len(part), label))
        out += [piece, " ", part]
        size += len(part)
        at = gap
    return "".join([*out, text[at:]]), held


class Field:
    def __init__(self, bits: int):
        k = len(KINDS) + 1
        self.node = np.zeros((1 << bits, k))
        self.pair = np.zeros((2, k, k))  # chain: label before, label after; skip: symmetric

    def scores(self, features: list[list[int]]) -> np.ndarray:
        return self.node[np.array(features, np.int64)].sum(axis=1)

    def train(self, graphs: list[Graph], steps: int) -> None:
        """Adam on the pseudo-likelihood: each labelled word given its features and its links' labels."""
        graphs = [g for g in graphs if len(g.spans)]
        if not graphs:
            return
        k = len(KINDS) + 1
        base = np.cumsum([0] + [len(g.spans) for g in graphs])
        feats = np.array([f for g in graphs for f in g.features], np.int64)
        label = np.concatenate([g.label for g in graphs])
        links = np.concatenate([g.links + np.array([b, b, 0]) for g, b in zip(graphs, base, strict=False)])
        skip = links[links[:, 2] == 1]
        told = np.ones(len(label), bool)
        held = np.concatenate([g.held for g in graphs])
        for a, b in ((0, 1), (1, 0)):  # alike a match but none itself: unlabelled
            told[skip[(label[skip[:, a]] > 0) & (label[skip[:, b]] == 0), b]] = False
        told |= held
        # the held-out mentions, few as they are, weigh as much as all other words together
        weight = told * np.where(held, max(1.0, (told & ~held).sum() / max(1, held.sum())), 1.0)
        links = links[told[links[:, 0]] & told[links[:, 1]]]
        i, j, kind = links.T
        share = weight / max(1.0, weight.sum())
        want, flat = np.eye(k)[label], feats.ravel()
        params = [self.node, self.pair]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            score = self.node[feats].sum(axis=1)
            for c in range(k):
                score[:, c] += np.bincount(j, self.pair[kind, label[i], c], len(score)) + np.bincount(i, self.pair[kind, c, label[j]], len(score))
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            off = (p - want) * share[:, None]
            node = 1e-5 * self.node + np.stack([np.bincount(flat, np.repeat(off[:, c], feats.shape[1]), len(self.node)) for c in range(k)], axis=1)
            onto = lambda at, to: np.stack([np.bincount(kind * k + label[at], off[to, c], 2 * k) for c in range(k)], axis=1).reshape(2, k, k)
            pair = 1e-5 * self.pair + onto(i, j) + onto(j, i).transpose(0, 2, 1)
            pair[1] = (pair[1] + pair[1].T) / 2
            for at, g in enumerate((node, pair)):
                first[at] = 0.9 * first[at] + 0.1 * g
                second[at] = 0.999 * second[at] + 0.001 * g * g
                params[at] -= 0.1 * (first[at] / (1 - 0.9**step)) / (np.sqrt(second[at] / (1 - 0.999**step)) + 1e-8)

    def marginals(self, graph: Graph, rounds: int) -> np.ndarray:
        """Label probabilities by loopy sum-product, the patterns' labels held fixed."""
        score = self.scores(graph.features)
        fixed = graph.label > 0
        score[fixed] = -50.0
        score[fixed, graph.label[fixed]] = 0.0
        if len(graph.links):
            i, j, kind = graph.links.T
            source, target = np.concatenate([i, j]), np.concatenate([j, i])
            pair = np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)])  # source label, target label
            reverse = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
            message = np.zeros((len(source), score.shape[1]))
            for _ in range(rounds):
                belief = score.copy()
                np.add.at(belief, target, message)
                out = (belief[source] - message[reverse])[:, :, None] + pair
                top = out.max(axis=1)
                new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                change = np.abs(new - message).max()
                message = 0.5 * (message + new)
                if change < 1e-3:
                    break
            score = score.copy()
            np.add.at(score, target, message)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def added(self, text: str, spans: list[list[tuple[int, int]]], plan: Plan) -> list[list[tuple[int, int]]]:
        """Spans by kind that the field adds to the patterns'."""
        graph = Graph(text, spans, plan.bits)
        out: list[list[tuple[int, int]]] = [[] for _ in KINDS]
        if not len(graph.spans) or (graph.label > 0).all():
            return out
        p = self.marginals(graph, plan.rounds)
        best = np.where(p.max(axis=1) >= plan.sure, p.argmax(axis=1), 0)
        best[graph.label > 0] = 0
        for i in np.flatnonzero(best).tolist():
            out[best[i] - 1].append(graph.spans[i])
        return out


def trained(docs: DataFrame, plan: Plan = Plan()) -> Field:
    """A field trained on a hashed sample of documents that hold a digit or an at sign, of at most sample_bytes.

    Null texts and texts over ``longest`` bytes are not in the sample; repeated rows count as often as they are
    drawn; without any such document all potentials are zero, and nothing is ever added.
    """
    some = docs.filter(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= plan.longest)).select("text")
    n, size = some.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = int(min(1.0, plan.sample_bytes / max(1, size)) * (1 << 30))
    draw = F.xxhash64(F.lit(plan.seed), "text")
    graphs, left, before = [], 2 * plan.sample_bytes, [""] * len(KINDS)
    for r in some.filter(F.pmod(draw, F.lit(1 << 30)) < share).orderBy(draw, "text").toLocalIterator():
        if len(r.text) > left:
            continue
        left -= len(r.text)
        spans = matched(r.text)
        graphs.append(Graph(r.text, spans, plan.bits))
        foreign = [(k, old) for k, old in enumerate(before) if old and any(spans)]
        text, held = with_mentions(r.text, spans, foreign, plan.seed)
        if held:
            graphs.append(Graph(text, matched(text), plan.bits, held))
        before = [r.text[f[0][0] : f[0][1]] if f else b for f, b in zip(spans, before, strict=True)]
    field = Field(plan.bits)
    field.train(graphs, plan.steps)
    return field


def listed(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans, strict=True) for a, b in sorted(found))


def both(text: str, field: Field, plan: Plan) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """The patterns' spans, and all spans."""
    if not _SIGN.search(text):
        none: list[list[tuple[int, int]]] = [[] for _ in KINDS]
        return none, none
    base = matched(text)
    more = field.added(text, base, plan)
    return base, [a + b for a, b in zip(base, more, strict=True)]


def found(docs: DataFrame, field: Field, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) for every row: counts and list of the patterns'
    matches, and the list of all spans, as kind:start:end in code points.

    A null text is an empty one. Repeated rows are each answered; an empty table gives no rows. Only doc_id
    and text are looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, base, spans = [[] for _ in KINDS], [], []
            for t in b.column(1):
                first, every = both(t.as_py() or "", field, plan)
                for k, found in enumerate(first):
                    n[k].append(len(found))
                base.append(listed(first))
                spans.append(listed(every))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in n], pa.array(base, pa.string()), pa.array(spans, pa.string())], ["doc_id", *counts, "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, {', '.join(c + ' long' for c in counts)}, base string, spans string")


def redact(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become the first's."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, found in zip(KINDS, spans, strict=True) for a, b in found):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field, plan: Plan = Plan()) -> DataFrame:
    """docs with text redacted, all other columns as they are, whatever their names.

    Null texts stay null and empty ones empty. Repeated rows are redacted alike; an empty table gives no rows.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if (x := t.as_py()) is None else redact(x, both(x, field, plan)[1]) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*docs.columns)


def op9_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = found(docs, trained(docs))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
