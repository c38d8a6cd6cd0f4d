"""Quality rules by distribution divergence: documents against references of their language, native expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ironlog.llm.common import SPACE, only, stored

WORDY = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
CLASSES = ("space", "lower", "upper", "digit", "punctuation", "symbol", "other")

#: A language has references of its own if it holds this share of all words, so there are at most 200.
LANGUAGE_SHARE = 0.005
#: A common word makes up this share of its language's words (so there are at most 500) and has at most LONGEST bytes.
COMMON_SHARE, LONGEST = 0.002, 64
#: Words are counted by hash first; only words in buckets that hold COMMON_SHARE are counted one by one.
BUCKETS = 1 << 12

#: Parts in which the share of a character class is counted.
STEPS = 1000

#: Guards: texts with fewer characters or words are too short to have a distribution.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: Base rule: this percentage of words in repeated three-word windows.
REPEATED = 50
#: Greatest Jensen-Shannon divergences (base 2, from 0 to 1), as (at any length, more for one character or word): a sample's
#: divergence from what it is drawn from falls as one over its length.
MOST_CLASSES, MOST_WORDS = (0.02, 25.0), (0.035, 8.0)


def words_of(text: Column) -> Column:
    """Words in order, separated by white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def _language(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(""))


def common_words(docs: DataFrame) -> DataFrame:
    """(language, words, shares, longest): each large language's common words in code point order, their shares of its words, and
    the most bytes that one of them has.

    Two passes over all texts, exact: counts by hash bucket, then counts of the words in buckets that are large enough
    to hold a common word.  Both are combined in map tasks, so a word that is everywhere is a row per task.
    """
    parts = F.split("text", SPACE + "+")
    docs = only(docs, "lang", "text").select(_language(F.col("lang")).alias("language"), F.explode(parts).alias("word")).where("word <> ''")
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
    sums = stored(docs.groupBy("language", bucket.alias("bucket")).agg(F.count("*").alias("n")), "buckets")
    languages = sums.groupBy("language").agg(F.sum("n").alias("total"))
    whole = languages.agg(F.sum("total").alias("whole"))
    large = languages.join(F.broadcast(whole)).where(F.col("total") >= LANGUAGE_SHARE * F.col("whole")).select("language", "total")  # one row
    heavy = sums.join(F.broadcast(large), "language").where(F.col("n") >= COMMON_SHARE * F.col("total")).select("language", "bucket", "total")
    heavy = stored(heavy, "heavy")  # at most 200 languages with 500 buckets
    found = docs.where(F.octet_length("word") <= LONGEST).withColumn("bucket", bucket).join(F.broadcast(heavy), ["language", "bucket"])
    found = found.groupBy("language", "word").agg(F.count("*").alias("n"), F.first("total").alias("total"))
    found = found.where(F.col("n") >= COMMON_SHARE * F.col("total")).select("language", "word", (F.col("n") / F.col("total")).alias("share"))
    lists = found.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("word", "share"))).alias("l"))  # at most 500
    lists = large.join(lists, "language", "left").select("language", F.coalesce("l", F.array().cast("array<struct<word:string,share:double>>")).alias("l"))
    longest = F.coalesce(F.array_max(F.transform("l.word", lambda w: F.octet_length(w))), F.lit(0))
    return stored(lists.select("language", F.col("l.word").alias("words"), F.col("l.share").alias("shares"), longest.alias("longest")), "common")


def _bin(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence."""
    m = p + q
    part = lambda x: F.when(x > 0, x / 2 * F.log2(2 * x / m)).otherwise(0.0)
    return part(p) + part(q)


def _words_apart(n_words: Column) -> Column:
    """Divergence of the histogram (common words, all others) from the reference; bins that the text lacks add half their share."""
    place = lambda w: F.array_position("words", w)
    held = F.transform("counts", lambda x: F.struct(F.get("shares", (place(x["word"]) - 1).cast("int")).alias("q"), x["n"].alias("n")))
    total = lambda values, kind: F.aggregate(values, F.lit(0).cast(kind), lambda a, b: a + b)
    found = total(F.transform(held, lambda h: _bin(h["n"] / n_words, h["q"])), "double")
    share = total(F.col("shares"), "double")
    lacking = share - total(F.transform(held, lambda h: h["q"]), "double")
    others = n_words - total(F.transform("counts", lambda x: x["n"].cast("long")), "long")
    return found + lacking / 2 + _bin(others / n_words, 1 - share)


def features(docs: DataFrame, common: DataFrame) -> DataFrame:
    """One row per document: doc_id, language, base counts, counts of character classes, and ``words_apart`` (null without a reference).

    All of it is computed inside the row from the whole text; the work of a text grows as n log n in its words.
    Windows are told apart by 64-bit hashes of their words; those of one text only meet each other.
    """
    d = only(docs, "doc_id", "lang", "text").select("doc_id", _language(F.col("lang")).alias("language"), F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORDY))
    d = d.select(
        "doc_id", "language", words_of(F.col("text")).alias("parts"), lines.alias("lines"), F.char_length("text").alias("n_chars"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("upper"), F.regexp_replace("text", r"\p{L}+", "").alias("rest"),
    )
    d = d.join(F.broadcast(common), "language", "left")  # at most 200 rows
    of = lambda characters: F.regexp_count("rest", F.lit(characters))
    window = lambda i: F.xxhash64(F.get("parts", i), F.get("parts", i + 1), F.get("parts", i + 2))
    d = d.select(
        "doc_id", "language", "words", "shares", "parts", "n_chars", "upper",
        F.size("parts").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.col("n_chars") - F.char_length("rest")).alias("letters"), F.char_length("rest").alias("others"),
        (F.char_length("rest") - F.char_length(F.regexp_replace("rest", SPACE + "+", ""))).alias("space"), of(f"[{SYMBOLS}]").alias("symbol"), of(r"\p{Nd}").alias("digit"), of(f"[{PUNCTUATION}]").alias("punctuation"),
        F.when(F.size("parts") >= 3, F.transform(F.sequence(F.lit(0), F.size("parts") - 3), window)).alias("windows"),
        F.filter("parts", lambda w: F.octet_length(w) <= F.col("longest")).alias("short"),
    )
    d = d.withColumn("present", F.array_intersect("words", "short"))
    # equal windows side by side, but only where there are any
    ordered = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("at"))))
    d = d.withColumns({
        "ordered": F.when(F.size(F.array_distinct("windows")) < F.size("windows"), ordered),
        "counts": F.transform("present", lambda w: F.struct(w.alias("word"), (F.size("short") - F.size(F.array_remove("short", w))).alias("n"))),
    })
    same = lambda x, i: F.coalesce(F.get("ordered", i)["w"] == x["w"], F.lit(False))
    twice = F.filter("ordered", lambda x, i: same(x, i - 1) | same(x, i + 1))
    d = d.withColumn("begins", F.sort_array(F.transform(twice, lambda x: x["at"])))
    # a window covers three words, or as many as there are before the next one begins
    steps = F.transform("begins", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("begins", i + 1) - x, F.lit(3))).cast("long"))
    covered = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))
    rest = F.col("others") - F.col("space") - F.col("digit") - F.col("punctuation") - F.col("symbol")
    classes = {"lower": F.col("letters") - F.col("upper"), "other": rest}
    n = F.col("n_words")
    return d.select(
        "doc_id", "language", "n_words", (F.col("n_chars") - F.col("space")).cast("long").alias("word_chars"),
        F.col("symbol").cast("long").alias("n_symbols"), "n_dup_lines", covered.alias("n_repeat_words"), F.col("n_chars").cast("long").alias("n_chars"),
        F.array(*(classes.get(c, F.col(c)).cast("long") for c in CLASSES)).alias("classes"),
        F.when(F.col("words").isNotNull() & (n > 0), F.round(_words_apart(n), 9)).alias("words_apart"),
    )


def class_references(rows: DataFrame, common: DataFrame) -> DataFrame:
    """(language, reference): shares of the character classes for each language of ``common``, and under a null language
    for all of them together.

    Medians over the documents that pass the base rules, in thousandths, so that junk moves them little while it is not
    half of a language.  They follow from counts per thousandth, which are combined in map tasks; at most 1001 rows a class.
    """
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)
    parts = F.transform("classes", lambda n: F.floor(STEPS * n / chars))
    counts = rows.where("NOT base_failed").select("language", F.posexplode(parts).alias("i", "part")).groupBy("language", "i", "part").agg(F.count("*").alias("n"))
    counts = stored(counts, "class_counts")
    own = counts.join(F.broadcast(common.select("language")), "language", "left_semi")
    every = counts.groupBy("i", "part").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("language"), "i", "part", "n")
    of = Window.partitionBy("language", "i")
    below = F.sum("n").over(of.orderBy("part"))
    half = own.unionByName(every).withColumns({"below": below, "all": F.sum("n").over(of)}).where("2 * below >= all")
    middle = half.groupBy("language", "i").agg(F.min("part").alias("part"))
    lists = middle.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("l"), F.sum("part").alias("total"))
    return lists.where("total > 0").select("language", F.transform("l", lambda x: x["part"] / F.col("total")).alias("reference"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the
    two divergences, classes_apart and words_apart.

    References are learned from all of ``docs``: per language the median shares of character classes over the documents
    that pass the base rules, and the shares of the common words among all words.  A document fails where its Jensen-Shannon divergence
    from its language's reference exceeds MOST_CLASSES (texts of LEAST_CHARS characters or more) or MOST_WORDS
    (texts of LEAST_WORDS words or more).  A language below LANGUAGE_SHARE of the words has no word
    reference (words_apart is null and judges nothing) and is held against the classes of all languages together.

    A null text is an empty one: no words, so the base rule fails it.  A null language is a language like any other.
    Rows that repeat are judged alike, each on its own; an empty table gives an empty result; further columns are ignored.
    """
    common = common_words(docs)
    n = F.col("n_words")
    failed = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * n)
    rows = stored(features(docs, common).withColumn("base_failed", failed), "features")
    references = stored(class_references(rows, common), "references")
    own = F.broadcast(references.where("language IS NOT NULL"))  # at most 200 rows
    every = F.broadcast(references.where("language IS NULL").select(F.col("reference").alias("any")))  # one row
    rows = rows.join(own, "language", "left").join(every, how="left").withColumn("reference", F.coalesce("reference", "any"))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)
    apart = reduce(lambda a, b: a + b, (_bin(F.col("classes")[i] / chars, F.col("reference")[i]) for i in range(len(CLASSES))))
    rows = rows.withColumn("classes_apart", F.when(chars > 0, F.round(apart, 9)))
    far = lambda apart, size, least, most: F.coalesce((F.col(size) >= least) & (F.col(apart) > most[0] + most[1] / F.col(size)), F.lit(False))
    odd = far("classes_apart", "n_chars", LEAST_CHARS, MOST_CLASSES) | far("words_apart", "n_words", LEAST_WORDS, MOST_WORDS)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~odd).alias("kept"), "classes_apart", "words_apart",
    )


def verdicts(docs: DataFrame) -> DataFrame:
    """``quality_rules`` without the two divergences."""
    return quality_rules(docs).drop("classes_apart", "words_apart")


#: The same verdicts from plain counts of words, windows and characters.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS language, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), covered AS (
  SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM win) q, (SELECT unnest([0, 1, 2]) AS j) k
  WHERE c > 1 GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(str_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), b AS (
  SELECT d.r, doc_id, language, len(w) AS n_words, length(t) AS n_chars, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS letters,
         length(t) - length(regexp_replace(t, '\p{{Nd}}', '', 'g')) AS digit, length(t) - length(regexp_replace(t, '[.,;:!?''"()-]', '', 'g')) AS punctuation
  FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
), f AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed,
         [n_chars - word_chars, letters - upper, upper, digit, punctuation, n_symbols, word_chars - letters - digit - punctuation - n_symbols] AS c FROM b
), totals AS (
  SELECT language, sum(n_words) AS total FROM f GROUP BY 1 HAVING sum(n_words) > 0 AND sum(n_words) >= {LANGUAGE_SHARE} * (SELECT sum(n_words) FROM f)
), words AS (
  SELECT r, language, word, count(*) AS n FROM (SELECT r, language, unnest(w) AS word FROM d) GROUP BY ALL
), common AS (
  SELECT language, word, sum(n) / any_value(total) AS q FROM words JOIN totals USING (language) WHERE strlen(word) <= {LONGEST}
  GROUP BY 1, 2 HAVING sum(n) >= {COMMON_SHARE} * any_value(total)
), cells AS (
  SELECT language, r, base_failed, i, c[i] AS n, n_chars FROM f, (SELECT unnest(range(1, 8)) AS i) k
), middle AS (
  SELECT language, i, quantile_disc(floor({STEPS} * n / n_chars), 0.5) AS m FROM cells JOIN totals USING (language) WHERE NOT base_failed GROUP BY 1, 2
), middles AS (
  SELECT i, quantile_disc(floor({STEPS} * n / n_chars), 0.5) AS m FROM cells WHERE NOT base_failed GROUP BY 1
), own AS (
  SELECT language, i, m / sum(m) OVER (PARTITION BY language) AS q FROM middle
), every AS (
  SELECT i, m / sum(m) OVER () AS q FROM middles
), bins AS (
  SELECT r, 'classes' AS kind, n / n_chars AS p, coalesce(own.q, every.q) AS q FROM cells LEFT JOIN own USING (language, i) LEFT JOIN every USING (i) WHERE n_chars > 0
  UNION ALL
  SELECT f.r, 'words', coalesce(words.n, 0) / f.n_words, common.q FROM f JOIN common USING (language) LEFT JOIN words ON words.r = f.r AND words.word = common.word WHERE f.n_words > 0
  UNION ALL
  SELECT f.r, 'words', 1 - (SELECT coalesce(sum(words.n), 0) FROM words JOIN common USING (language, word) WHERE words.r = f.r) / f.n_words,
         1 - (SELECT coalesce(sum(q), 0) FROM common WHERE common.language = f.language) FROM f JOIN totals USING (language) WHERE f.n_words > 0
), apart AS (
  SELECT r, kind, round(sum(CASE WHEN p > 0 THEN p / 2 * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q / 2 * log2(2 * q / (p + q)) ELSE 0 END), 9) AS js FROM bins GROUP BY 1, 2
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND NOT coalesce(n_chars >= {LEAST_CHARS} AND x.js > {MOST_CLASSES[0]} + {MOST_CLASSES[1]} / n_chars, false)
       AND NOT coalesce(n_words >= {LEAST_WORDS} AND y.js > {MOST_WORDS[0]} + {MOST_WORDS[1]} / n_words, false) AS kept
FROM f LEFT JOIN apart x ON x.r = f.r AND x.kind = 'classes' LEFT JOIN apart y ON y.r = f.r AND y.kind = 'words'
"""
