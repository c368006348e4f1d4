"""Quality rules with thresholds read from mergeable quantile sketches of each language and source.

Counts are made per document inside one row by array functions. Four ratios per document (symbols, repeated lines and
repeated words in 1/10,000, mean word length in 1/100 characters) go into sketches: a value keeps its six leading
bits, and a sketch is the number of rows per kept value. Sketches of equal keys merge by adding, so they are
pre-aggregated before the shuffle and have at most a few hundred rows for a key, however many documents it holds.
A key's sketch merges into that of its language, and these into one of all rows; a (language, source) with fewer than
`least_rows` rows takes the thresholds of its language, and a language that has fewer takes those of all rows.

A threshold is read from sketches alone: it lies beyond a high (for word length also a low) quantile by `reach` times
that quantile's distance from the median, so it follows how far the group itself spreads. Where there is no spread up to
the quantile, the ratio's own step takes its place: what one symbol, one repeated line or one repeated window of words
makes in the group's short documents, read from sketches of their lengths (`LENGTHS`). So a clean text with a few symbols
in a group that has none stays, and how many are few follows how long the group's texts are. (A sketch's bucket is no
narrower limit than that but for word length.) Each ratio has its quantile, reach and step in `RULES`. A document fails when
a ratio lies beyond its threshold; a group in which all documents are alike loses none of them, and a fixed share of rows
is never cut off. Rows that fail the base rule are not in the sketches.

Null and empty texts have no words and fail the base rule. A very long text is counted like any other, inside its
row. Null lang or source form keys of their own. Repeated rows count each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, checkpointed


@dataclass(frozen=True)
class Rule:
    """Quantiles in percent, and how many of their distances from the median a threshold lies beyond; 0: no such side. The
    ratio's least step is `unit` by a document's length `per`."""

    high: int
    reach: int
    unit: int
    per: str
    low: int = 0


RULES = {
    "symbol_ratio": Rule(80, 8, 10_000, "word_chars"),
    "dup_line_ratio": Rule(98, 2, 10_000, "n_lines"),
    "repeat_ratio": Rule(98, 2, 60_000, "n_words"),
    "word_length": Rule(90, 5, 100, "n_words", 10),
}
#: Lengths, and the percentage of a group's documents that counts as short.
LENGTHS = {"word_chars": 2, "n_lines": 10, "n_words": 10}
LEAST_ROWS = 200
SALTS = 32
BROADCAST_ROWS = 20_000


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more: windows are sorted by hash beside their place, neighbours
    with equal hashes are kept, and the kept places, in order, cover three words each less what the next covers."""
    n = F.size(words)
    hashes = F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, words[i + 1], words[i + 2]))
    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # get() gives null beyond either end.
    places = lambda s: F.sort_array(
        F.transform(
            F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"],
        )
    )
    cover = lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    # Most texts repeat no window and need not be sorted.
    again = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(placed(h), lambda s: _let(places(s), cover)))
    return _let(hashes, again)


def text_counts(docs: DataFrame, *carry: str) -> DataFrame:
    """carry and the counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\f\r", "") != "")
    counts = lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"))
    dups = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    return (
        docs.select(
            *carry,
            _let(words_of(F.col("text")), counts).alias("w"),
            _let(lines, dups).alias("l"),
            F.char_length(F.translate(text, " \t\n\x0b\f\r", "")).alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"),
        )
        .select(
            *carry,
            F.col("w.n_words").cast("long").alias("n_words"),
            F.col("word_chars").cast("long").alias("word_chars"),
            F.col("n_symbols").cast("long").alias("n_symbols"),
            F.col("l.n_dup_lines").cast("long").alias("n_dup_lines"),
            F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
            F.col("l.n_lines").cast("long").alias("n_lines"),
        )
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def _ratio(part: str, whole: str, unit: int) -> Column:
    return F.expr(f"({part} * {unit}) div greatest({whole}, 1)")


def ratios() -> dict[str, Column]:
    return {
        "symbol_ratio": _ratio("n_symbols", "word_chars", 10000),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines", 10000),
        "repeat_ratio": _ratio("n_repeat_words", "n_words", 10000),
        "word_length": _ratio("word_chars", "n_words", 100),
    }


def sketch_value(value: Column) -> Column:
    """value with all but its six leading bits cleared: one bucket of a sketch, at most 1/32 below value."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def _percent(field: str) -> Column:
    """Quantile `low` or `high` of what a sketch row is about."""
    told = {name: getattr(rule, field) for name, rule in RULES.items()} | (LENGTHS if field == "low" else dict.fromkeys(LENGTHS, 50))
    return F.create_map(*[x for name, value in told.items() for x in (F.lit(name), F.lit(value))])[F.col("ratio")]


def _bucket(value: Column) -> Column:
    """Width of the sketch's bucket that holds value."""
    return F.call_function("shiftleft", F.lit(1), F.greatest(F.length(F.bin(value)) - 6, F.lit(0)))


def thresholds(counts: DataFrame, *, least_rows: int = LEAST_ROWS) -> DataFrame:
    """lang, source, and for each ratio its lowest and highest value that passes."""
    points = counts.filter(~F.col("base_failed")).select(
        "lang", "source", F.explode(F.array(*[F.struct(F.lit(n).alias("ratio"), sketch_value(F.col(n)).alias("value")) for n in (*RULES, *LENGTHS)])).alias("p")
    )
    own = points.groupBy("lang", "source", "p.ratio", "p.value").agg(F.count("*").alias("n"))
    by_lang = own.groupBy("lang", "ratio", "value").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("ratio", "value").agg(F.sum("n").alias("n"))

    def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
        up = Window.partitionBy(*keys, "ratio").orderBy("value")
        told = sketch.withColumn("upto", F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rows", F.sum("n").over(Window.partitionBy(*keys, "ratio")))
        at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * percent, F.col("value")))
        return told.groupBy(*keys, "ratio").agg(
            F.struct(F.max("rows").alias("rows"), at(_percent("low")).alias("low"), at(F.lit(50)).alias("mid"), at(_percent("high")).alias("high")).alias("q")
        )

    mine = quantiles(own, "lang", "source")
    lang = quantiles(by_lang, "lang").select(F.col("lang").alias("l_lang"), F.col("ratio").alias("l_ratio"), F.col("q").alias("l"))
    everything = quantiles(overall).select(F.col("ratio").alias("a_ratio"), F.col("q").alias("a"))
    best = (
        mine.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("ratio") == F.col("l_ratio")))
        .join(everything, F.col("ratio") == F.col("a_ratio"))
        .withColumn("q", F.when(F.col("q.rows") >= least_rows, F.col("q")).when(F.col("l.rows") >= least_rows, F.col("l")).otherwise(F.col("a")))
    )
    told = best.groupBy("lang", "source").agg(*[F.max(F.when(F.col("ratio") == n, F.col("q"))).alias(n) for n in (*RULES, *LENGTHS)])

    def sides(name: str, rule: Rule) -> list[Column]:
        q = lambda part: F.col(f"{name}.{part}")
        step = F.expr(f"{rule.unit} div greatest({rule.per}.low, 1)")
        beyond = lambda edge, distance: rule.reach * F.greatest(distance, step, _bucket(edge))
        return [(q("low") - beyond(q("low"), q("mid") - q("low"))).alias(f"low_{name}"), (q("high") + beyond(q("high"), q("high") - q("mid"))).alias(f"high_{name}")]

    return told.select("lang", "source", *[c for name, rule in RULES.items() for c in sides(name, rule)])


def verdict() -> Column:
    """Whether a row with counts and limits stays. One expression, so that no part of it is computed ahead and again."""
    inside = F.lit(True)
    for name, rule in RULES.items():
        inside &= F.col(name) <= F.col(f"high_{name}")
        if rule.low:
            inside &= F.col(name) >= F.col(f"low_{name}")
    return F.when(F.col("base_failed"), F.lit(False)).otherwise(inside)


def judged(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """counts with `kept`. A group without limits has only rows that fail the base rule. Few limits go to all tasks (their number is checked); otherwise a salt on both sides spreads a
    language and source that hold much of the rows."""
    limits = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    if limits.count() <= BROADCAST_ROWS:
        return counts.join(F.broadcast(limits), same, "left").withColumn("kept", verdict())
    salted = limits.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = counts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("salt") == F.col("t_salt")), "left").withColumn("kept", verdict())


def within_rules(docs: DataFrame, *, least_rows: int = LEAST_ROWS) -> DataFrame:
    """The rows of docs that stay, with all their columns; rows that repeat stay or go together, null texts go, an empty
    table stays empty. Texts are counted once for the sketches and once for the
    verdict, which costs less than moving or storing them."""
    limits = checkpointed(thresholds(text_counts(docs, "lang", "source").withColumns(ratios()), least_rows=least_rows))
    whole = docs.select("doc_id", "lang", "source", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    counted = text_counts(whole, "doc_id", "lang", "source", "row").withColumns(ratios())
    return judged(counted, limits).filter("kept").select("row.*")


def quality_rules(docs: DataFrame, *, least_rows: int = LEAST_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    counts = checkpointed(text_counts(docs, "doc_id", "lang", "source").withColumns(ratios()))
    limits = checkpointed(thresholds(counts, least_rows=least_rows))
    return judged(counts, limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
p AS (SELECT rid, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM s),
tri AS (
  SELECT rid, i, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (
  SELECT rid, i FROM tri WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, w1, w2, w3) > 1),
cover AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY rid),
c AS (
  SELECT s.rid, doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
  FROM s LEFT JOIN cover USING (rid)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols * 10000 // greatest(word_chars, 1) AS symbol_ratio, n_dup_lines * 10000 // greatest(n_lines, 1) AS dup_line_ratio,
         n_repeat_words * 10000 // greatest(n_words, 1) AS repeat_ratio, word_chars * 100 // greatest(n_words, 1) AS word_length
  FROM c),
u AS (UNPIVOT (SELECT *, word_chars AS l1, n_lines AS l2, n_words AS l3 FROM f) ON symbol_ratio, dup_line_ratio, repeat_ratio, word_length, l1, l2, l3 INTO NAME ratio VALUE v),
k AS (SELECT rid, lang, source, ratio, v, greatest(length(bin(v)) - 6, 0) AS e FROM u WHERE NOT base_failed),
b AS (SELECT rid, lang, source, ratio, ((v >> e) << e) AS value FROM k),
own AS (SELECT lang, source, ratio, value, count(*) AS n FROM b GROUP BY ALL),
grp AS (
  SELECT 1 AS level, lang, source, ratio, value, n FROM own
  UNION ALL SELECT 2, lang, NULL, ratio, value, sum(n) FROM own GROUP BY lang, ratio, value
  UNION ALL SELECT 3, NULL, NULL, ratio, value, sum(n) FROM own GROUP BY ratio, value),
rule(ratio, high, reach, low, unit, per) AS (VALUES {", ".join([f"('{n}', {r.high}, {r.reach}, {r.low}, {r.unit}, 'l{list(LENGTHS).index(r.per) + 1}')" for n, r in RULES.items()] + [f"('l{i}', 50, 0, {p}, 0, '')" for i, p in enumerate(LENGTHS.values(), 1)])}),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY value) AS upto, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total
  FROM grp JOIN rule USING (ratio)),
q AS (
  SELECT level, lang, source, ratio, reach, unit, per, max(total) AS total, min(value) FILTER (upto * 100 >= total * low) AS lo,
         min(value) FILTER (upto * 100 >= total * 50) AS mid, min(value) FILTER (upto * 100 >= total * high) AS hi
  FROM cum GROUP BY level, lang, source, ratio, reach, unit, per),
best AS (
  SELECT m.lang, m.source, m.ratio, m.reach, m.unit, m.per,
         CASE WHEN m.total >= {LEAST_ROWS} THEN m WHEN l.total >= {LEAST_ROWS} THEN l ELSE a END AS c
  FROM q m JOIN q l ON l.level = 2 AND l.lang IS NOT DISTINCT FROM m.lang AND l.ratio = m.ratio
  JOIN q a ON a.level = 3 AND a.ratio = m.ratio WHERE m.level = 1),
lim AS (
  SELECT b.lang, b.source, b.ratio, b.c.hi + b.reach * greatest(b.c.hi - b.c.mid, b.unit // greatest(s.c.lo, 1), 1 << greatest(length(bin(b.c.hi)) - 6, 0)) AS most,
         CASE WHEN b.ratio IN ({", ".join(f"'{n}'" for n, r in RULES.items() if r.low)})
              THEN b.c.lo - b.reach * greatest(b.c.mid - b.c.lo, b.unit // greatest(s.c.lo, 1), 1 << greatest(length(bin(b.c.lo)) - 6, 0)) ELSE 0 END AS least
  FROM best b JOIN best s ON s.ratio = b.per AND s.lang IS NOT DISTINCT FROM b.lang AND s.source IS NOT DISTINCT FROM b.source),
bad AS (
  SELECT DISTINCT u.rid FROM u JOIN lim
    ON lim.lang IS NOT DISTINCT FROM u.lang AND lim.source IS NOT DISTINCT FROM u.source AND lim.ratio = u.ratio
  WHERE u.v > lim.most OR u.v < lim.least)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept
FROM f
"""
