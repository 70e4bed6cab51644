"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are each
compared with its language's reference by Jensen-Shannon distance. The references are
counted over all documents: class totals, and the most frequent words of the language.
Documents under a minimum length are not judged on that histogram, since a few words say
little about a distribution. A language without enough text is compared with the pooled
reference of all documents.

Words are read twice: once to count them for the references, once for each document's
own figures, which are stored without the text. Nothing is shuffled by document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import stored, table, words_of

# The base rules' symbols, window and limits.
SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30

#: Everything outside a class, by class; what no class holds is the last class, mostly lower-case letters.
OUTSIDE = {
    "upper": "[^A-Z]+",
    "digit": "[^0-9]+",
    "accented": r"[\x00-\x7F]+",
    "symbol": SYMBOLS,
    "stop": "[^.,;:?'\"()-]+",
    "mark": r"[^!@\\\[\]{}^_`~/+=]+",
}
POOLED = "*"
#: References are broadcast while they are at most so many; one row a language.
MOST_BROADCAST = 2_000


@dataclass(frozen=True)
class Rules:
    """common: words of a reference; least_chars, least_words: below these the histogram is not judged;
    most_class, most_words: the largest Jensen-Shannon distances (0 to 1) of a kept document;
    least_reference: words a language needs for a reference of its own."""

    common: int = 64
    least_chars: int = 300
    least_words: int = 60
    most_class: float = 0.24
    most_words: float = 0.45
    least_reference: int = 5_000


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside any 8-word window that is found at least twice in the text."""

    def windows(h: Column) -> Column:
        starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    def covered(keys: Column) -> Column:
        def repeats(z: Column) -> Column:
            again = F.transform(z, lambda x, i: F.when((x["key"] == F.get(z, i - 1)["key"]) | (x["key"] == F.get(z, i + 1)["key"]), x["at"]))
            return F.array_sort(F.filter(again, lambda at: at.isNotNull()))

        def total(p: Column) -> Column:
            step = F.transform(p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW))))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

        ordered = F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("key"), i.alias("at"))))
        some = let(ordered, lambda z: let(repeats(z), total))
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), some).otherwise(F.lit(0).cast("long"))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: let(windows(h), covered))


def runs(ordered: Column) -> Column:
    """[(word, n)] of a sorted array."""

    def body(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda w, i: F.when(F.get(s, i + 1).isNull() | (F.get(s, i + 1) != w), i)), lambda i: i.isNotNull())
        return let(ends, lambda e: F.transform(e, lambda at, j: F.struct(F.get(s, at).alias("word"), (at - F.coalesce(F.get(e, j - 1), F.lit(-1))).cast("long").alias("n"))))

    return let(ordered, body)


def common_words(docs: DataFrame, rules: Rules) -> list[tuple[str, str, int]]:
    """(lang, word, n): the most frequent words of each language, and of all documents as POOLED.

    Bounded by ``common`` rows a language; every word of every document is counted, documents without a language
    among all. Ties go to the smaller word.
    """
    each = docs.select(F.coalesce("lang", F.lit(POOLED)).alias("lang"), F.explode(words_of(F.col("text"))).alias("word"))
    counts = each.groupBy("lang", "word").agg(F.count("*").alias("n"))
    held = counts.groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("n"))
    named = F.filter("by", lambda x: x["lang"] != POOLED)
    whole = F.array(F.struct(F.lit(POOLED).alias("lang"), F.col("n").alias("n")))
    every = held.select("word", F.inline(F.concat(named, whole)))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    tops = every.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= rules.common)
    return [(r.lang, r.word, r.n) for r in tops.collect()]


def measured(docs: DataFrame, common: list[str]) -> DataFrame:
    """The figures of each document: base columns, class counts, and counts of the common words it holds."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # inline() keeps the optimizer from repeating the split in each expression that uses its result
    split = docs.select("doc_id", "lang", text.alias("text"), F.inline(F.array(F.struct(words_of(F.col("text")).alias("words")))))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hits = F.filter("words", lambda w: w.isin(common)) if common else F.slice("words", 1, 0)
    classes = [F.length(F.regexp_replace("text", outside, "")).cast("long").alias(name) for name, outside in OUTSIDE.items()]
    return split.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length("text").cast("long").alias("chars"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        *classes,
        runs(F.sort_array(hits)).alias("hits"),
    )


def class_counts() -> Column:
    named = [F.col(c) for c in OUTSIDE]
    rest = F.col("word_chars")
    for c in named:
        rest = rest - c
    return F.array(*named, F.greatest(rest, F.lit(0)))


def references(figures: DataFrame, tops: list[tuple[str, str, int]], rules: Rules) -> DataFrame:
    """One row a language: ref_lang, ref_words, ref_shares (of the words, then of all others), ref_classes (shares)."""
    spark = figures.sparkSession
    n = len(OUTSIDE) + 1
    sums = figures.select(F.coalesce("lang", F.lit(POOLED)).alias("lang"), "n_words", class_counts().alias("c"))
    rows = sums.groupBy("lang").agg(F.sum("n_words").alias("words"), *[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(n)]).collect()
    totals = {r["lang"]: (r["words"], [r[f"c{i}"] for i in range(n)]) for r in rows}
    all_words = sum(w for w, _ in totals.values())
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for lang, word, count in tops:
        by_lang.setdefault(lang, []).append((count, word))
    found = {POOLED: (all_words, [sum(c[i] for _, c in totals.values()) for i in range(n)], by_lang.get(POOLED, []))}
    found |= {k: (w, c, by_lang.get(k, [])) for k, (w, c) in totals.items() if w >= rules.least_reference and k != POOLED}
    out = []
    for lang, (words, classes, best) in found.items():
        best = sorted(best, key=lambda x: (-x[0], x[1]))
        shares = [c / words for c, _ in best] if words else []
        out.append((lang, [w for _, w in best], [*shares, max(0.0, 1.0 - sum(shares))], [c / max(1, sum(classes)) for c in classes]))
    listed = lambda values, kind: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    each = [F.struct(F.lit(a).alias("ref_lang"), listed(b, "string").alias("ref_words"), listed(c, "double").alias("ref_shares"), listed(d, "double").alias("ref_classes")) for a, b, c, d in out]
    made = spark.range(1).select(F.inline(F.array(*each)))
    return F.broadcast(made) if len(out) <= MOST_BROADCAST else made


def term(p: Column, q: Column) -> Column:
    """What one class adds to twice the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def distances(figures: DataFrame, refs: DataFrame, rules: Rules) -> DataFrame:
    """With class_distance and word_distance: Jensen-Shannon distances, null where a guard holds."""
    known = [r.ref_lang for r in refs.select("ref_lang").collect()]
    use = F.when(F.col("lang").isin(known), F.col("lang")).otherwise(F.lit(POOLED))
    rows = figures.withColumn("use", use).join(refs, F.col("use") == F.col("ref_lang"), "left")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    root = lambda x: F.sqrt(F.greatest(F.lit(0.0), x / 2))
    shares = F.transform(class_counts(), lambda c: c / F.greatest(F.col("word_chars"), F.lit(1)))
    by_class = root(total(F.zip_with(shares, "ref_classes", term)))
    held = F.transform("hits", lambda h: F.struct((h["n"] / F.greatest(F.col("n_words"), F.lit(1))).alias("p"), F.array_position("ref_words", h["word"]).alias("at")))
    held = F.filter(held, lambda h: h["at"] > 0)

    def by_word(h: Column) -> Column:
        pairs = F.transform(h, lambda x: F.struct(x["p"].alias("p"), F.element_at("ref_shares", x["at"].cast("int")).alias("q")))

        def body(z: Column) -> Column:
            p, q = total(F.transform(z, lambda x: x["p"])), total(F.transform(z, lambda x: x["q"]))
            other = F.element_at("ref_shares", -1)
            # words of the reference that the document lacks add their whole share
            return root(total(F.transform(z, lambda x: term(x["p"], x["q"]))) + F.greatest(F.lit(0.0), 1 - other - q) + term(F.greatest(F.lit(0.0), 1 - p), other))

        return let(pairs, body)

    return rows.withColumn("class_distance", F.when(F.col("word_chars") >= rules.least_chars, by_class)).withColumn("word_distance", F.when(F.col("n_words") >= rules.least_words, let(held, by_word)))


def judged(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance, kept), a row per document row.

    A null text is an empty one: no words, base_failed. A null lang is compared with all documents together.
    Repeated rows are judged each; an empty table gives no rows. Only doc_id, text and lang are looked at.
    """
    docs = docs.select("doc_id", "lang", "text")
    tops = common_words(docs, rules)
    figures = stored(measured(docs, sorted({w for _, w, _ in tops})))
    rows = distances(figures, references(figures, tops, rules), rules)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    near = F.coalesce(F.col("class_distance") <= rules.most_class, F.lit(True)) & F.coalesce(F.col("word_distance") <= rules.most_words, F.lit(True))
    return rows.select("doc_id", "n_words", "word_chars", F.col("symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "class_distance", "word_distance", (~failed & near).alias("kept"))


def op5_quality_rules(spark, sf_dir):
    return judged(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


OP5_SQL = r"""
WITH d0 AS (SELECT doc_id, coalesce(lang, '*') AS lang, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
d AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d0),
wc AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM d) GROUP BY lang, word),
tops AS (SELECT * FROM (SELECT * FROM wc WHERE lang <> '*' UNION ALL SELECT '*', word, sum(n) FROM wc GROUP BY word)
         QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(word)) <= 64),
win AS (SELECT rid, i, w[i:i + 7] AS k FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d)),
rep AS (SELECT rid, count(DISTINCT c) AS n FROM (
          SELECT rid, unnest(range(i, i + 8)) AS c FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1) GROUP BY rid),
f AS (SELECT d.rid, doc_id, lang, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat([''], w), 'string_agg', '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        [length(regexp_replace(text, '[^A-Z]+', '', 'g')), length(regexp_replace(text, '[^0-9]+', '', 'g')), length(regexp_replace(text, '[\x00-\x7F]+', '', 'g')),
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')), length(regexp_replace(text, '[^.,;:?''"()-]+', '', 'g')), length(regexp_replace(text, '[^!@\[\]{}^_`~/+=\\]+', '', 'g'))] AS named
      FROM d LEFT JOIN rep ON d.rid = rep.rid),
f2 AS (SELECT *, list_concat(named, [greatest(word_chars - list_sum(named), 0)]) AS cls FROM f),
tot AS (SELECT lang, CAST(sum(n_words) AS DOUBLE) AS words FROM f2 GROUP BY lang),
cl AS (SELECT lang, i, CAST(sum(c) AS DOUBLE) AS c FROM (SELECT lang, unnest(cls) AS c, unnest(range(1, 8)) AS i FROM f2) GROUP BY lang, i),
keep AS (SELECT lang, words FROM tot WHERE words >= 5000 AND lang <> '*'),
allw AS (SELECT sum(words) AS words FROM tot),
refw0 AS (SELECT t.lang, t.word, t.n, k.words FROM tops t JOIN keep k USING (lang)
          UNION ALL SELECT lang, word, n, (SELECT words FROM allw) FROM tops WHERE lang = '*'),
refw AS (SELECT lang, word, n / words AS q FROM refw0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(word)) <= 64),
refo AS (SELECT lang, greatest(0.0, 1 - sum(q)) AS other FROM refw GROUP BY lang),
refc AS (SELECT lang, i, c / sum(c) OVER (PARTITION BY lang) AS q FROM (
          SELECT cl.* FROM cl JOIN keep USING (lang) UNION ALL SELECT '*', i, sum(c) FROM cl GROUP BY i)),
u AS (SELECT f2.*, coalesce(k.lang, '*') AS use_lang FROM f2 LEFT JOIN keep k ON f2.lang = k.lang),
cd AS (SELECT rid, sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS dist
       FROM (SELECT rid, r.q, x.c / greatest(x.word_chars, 1) AS p FROM (SELECT rid, use_lang, word_chars, unnest(cls) AS c, unnest(range(1, 8)) AS i FROM u) x JOIN refc r ON r.lang = x.use_lang AND r.i = x.i) GROUP BY rid),
hit AS (SELECT rid, use_lang, word, count(*) / any_value(n_words) AS p FROM (SELECT rid, use_lang, n_words, unnest(w) AS word FROM u) GROUP BY rid, use_lang, word),
wd0 AS (SELECT h.rid, sum(p) AS p, sum(q) AS q, sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) AS s FROM hit h JOIN refw r ON r.lang = h.use_lang AND r.word = h.word GROUP BY h.rid),
wd AS (SELECT u.rid, greatest(0.0, 1 - coalesce(p, 0)) AS po, o.other AS qo, coalesce(s, 0) + greatest(0.0, 1 - o.other - coalesce(q, 0)) AS s FROM u JOIN refo o ON o.lang = u.use_lang LEFT JOIN wd0 ON wd0.rid = u.rid),
wd2 AS (SELECT rid, sqrt(greatest(0.0, (s + CASE WHEN po > 0 THEN po * log2(po / ((po + qo) / 2)) ELSE 0 END + CASE WHEN qo > 0 THEN qo * log2(qo / ((po + qo) / 2)) ELSE 0 END) / 2)) AS dist FROM wd)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND (word_chars < 300 OR cd.dist <= 0.24) AND (n_words < 60 OR wd2.dist <= 0.45) AS kept
FROM u JOIN cd USING (rid) JOIN wd2 USING (rid)
"""
