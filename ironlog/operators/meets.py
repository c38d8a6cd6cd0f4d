"""Competition results: search, unit conversion, reshaping, integration."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ironlog.functions.patterns import PIECE, Needs, needed
from ironlog.functions.stats import top_rows
from ironlog.sources.schemas import MEET_COLUMNS, MEET_WEIGHTS

LBS_PER_KG = 2.20462

# Queries tested in one projection.
_PATTERNS = 50
# Parts that queries matching every row are dealt to.
_SALTS = 64


def _words(query: str) -> list[str]:
    """Words of a query that count."""
    return [w for w in query.lower().split() if len(w) > 2]


def _word_patterns(query: str) -> list[str]:
    """The same of an expression; none if its words are not expressions by themselves."""
    try:
        return [w for w in _words(query) if re.compile(w)]
    except re.error:
        return []


def _rarity(texts: Sequence[str]) -> int:
    return min(map(len, texts))


def _asked(meets: DataFrame, names: str | Sequence[str] | DataFrame) -> DataFrame:
    """The searched names once each, with their words of more than two letters."""
    if isinstance(names, DataFrame):
        asked = names.select(F.col(names.columns[0]).alias("query"))
    else:
        listed = [names] if isinstance(names, str) else list(names)
        asked = meets.sparkSession.createDataFrame([(n,) for n in listed], "query string")
    words = F.filter(
        F.split(F.trim(F.lower("query")), r"(?U)\s+"), lambda w: F.length(w) > 2
    )
    return asked.filter(F.col("query").isNotNull()).distinct().withColumn("_words", words)


def _containing(names: DataFrame, asked: DataFrame, text: Column) -> DataFrame:
    """(Name, query, _words) of the names that contain ``text`` of a query.

    Names are cut into their pieces of the lengths asked for, so containment is an
    equality join: the work grows with the names and with the queries, not with their
    product.
    """
    wanted = asked.select("query", "_words", text.alias("_piece"))
    # as many rows as there are different lengths
    lengths = [r[0] for r in wanted.select(F.length("_piece")).distinct().collect()]
    size = F.col("_size")
    pieces = (
        names.select("Name", F.lower("Name").alias("_text"))
        .select("*", F.explode(F.array(*map(F.lit, sorted(lengths)))).alias("_size"))
        .filter(F.length("_text") >= size)
        .select(
            "Name",
            F.explode(
                F.array_distinct(
                    F.transform(
                        F.sequence(
                            F.lit(1), F.when(size == 0, 1).otherwise(F.length("_text") - size + 1)
                        ),
                        lambda at: F.substring("_text", at, size),
                    )
                )
            ).alias("_piece"),
        )
    ) if lengths else names.select("Name", F.lit("").alias("_piece")).filter("false")
    return pieces.join(wanted, "_piece").select("Name", "query", "_words")


def _literal_hits(meets: DataFrame, asked: DataFrame, fuzzy: bool) -> tuple[DataFrame, DataFrame]:
    """(Name, query, tier), and the queries that match every row."""
    names = meets.select("Name").filter(F.col("Name").isNotNull()).distinct()
    direct = _containing(names, asked, F.lower("query"))
    hits = direct.select("Name", "query", F.lit(1).alias("tier"))
    if not fuzzy:
        return hits, asked.filter("false").select("query")
    open_ = asked.join(direct.select("query").distinct(), "query", "left_anti")
    # the longest word leads, the others are checked on what it finds
    longest = F.array_sort(
        "_words", lambda x, y: F.length(y) - F.length(x)
    )[0]
    led = _containing(names, open_.filter(F.size("_words") > 0), longest)
    every_word = F.forall("_words", lambda w: F.lower("Name").contains(w))
    hits = hits.unionByName(
        led.filter(every_word).select("Name", "query", F.lit(2).alias("tier"))
    )
    return hits, open_.filter(F.size("_words") == 0).select("query")


def _listed_hits(names: DataFrame, queries: Sequence[str], fuzzy: bool, regex: bool) -> DataFrame:
    """(Name, query, tier) for a few queries at a time, each tested on every different name."""
    lowered = F.lower("Name")

    def tier_of(query: str) -> Column:
        if regex:
            hit = F.when(F.col("Name").rlike("(?i)" + query), 1)
            words = [F.col("Name").rlike("(?i)" + w) for w in _word_patterns(query)]
        else:
            hit = F.when(lowered.contains(F.lower(F.lit(query))), 1)
            words = [lowered.contains(F.lower(F.lit(w))) for w in _words(query)]
        return hit.when(reduce(and_, words), 2) if fuzzy and words else hit

    found = []
    for at in range(0, len(queries), _PATTERNS):
        candidates = [
            F.struct(F.lit(q).alias("query"), tier_of(q).alias("tier"))
            for q in queries[at : at + _PATTERNS]
        ]
        kept = F.filter(F.array(*candidates), lambda c: c["tier"].isNotNull())
        found.append(names.select("Name", F.explode(kept).alias("_hit")).select("Name", "_hit.*"))
    return reduce(DataFrame.unionByName, found)


def _indexed_hits(names: DataFrame, needs: Mapping[str, Sequence[Needs]], fuzzy: bool) -> DataFrame:
    """The same for expressions with needed text: names meet them by pieces of three letters.

    ``needs`` has, for each expression, the needed text of the whole and, where words count, of one word.
    A name that lacks the needed text cannot match, and the expression itself decides on the others.
    """
    asked = [
        (query, tier, text[:PIECE], text)
        for query, tiers in needs.items()
        for tier, texts in enumerate(tiers, 1)
        for text in texts or ()
    ]
    schema = "query string, tier int, _piece string, _text string"
    wanted = names.sparkSession.createDataFrame(asked, schema)
    at = F.sequence(F.lit(1), F.length("_lowered") - PIECE + 1)
    pieces = (
        names.select("Name", F.lower("Name").alias("_lowered"))
        .filter(F.length("_lowered") >= PIECE)
        .select(
            "*",
            F.explode(
                F.array_distinct(F.transform(at, lambda i: F.substring("_lowered", i, F.lit(PIECE))))
            ).alias("_piece"),
        )
    )
    near = (
        pieces.join(wanted, "_piece")
        .filter(F.contains("_lowered", "_text"))
        .select("Name", "query", "tier")
        .distinct()
    )
    words = F.filter(F.split(F.trim(F.lower("query")), r"(?U)\s+"), lambda w: F.length(w) > 2)
    parts = F.when(F.col("tier") == 1, F.array("query")).otherwise(words)
    return near.filter(F.forall(parts, lambda p: F.rlike(F.col("Name"), F.concat(F.lit("(?i)"), p))))


def _pattern_hits(
    meets: DataFrame, queries: Sequence[str], fuzzy: bool, regex: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(Name, query, tier) of queries known to the driver, and those that match every row.

    Up to _PATTERNS queries, and expressions without needed text, are tested on every different name.
    """
    names = meets.select("Name").filter(F.col("Name").isNotNull()).distinct()
    needs = {}
    if regex and len(queries) > _PATTERNS:
        for query in queries:
            by_word = [needed(w) for w in _word_patterns(query)] if fuzzy else []
            whole, word = needed(query), max((n for n in by_word if n), key=_rarity, default=None)
            if whole and (word or not by_word):
                needs[query] = (whole, word)
    tested = [q for q in queries if q not in needs]
    parts = [_listed_hits(names, tested, fuzzy, regex)] if tested else []
    if needs:
        parts.append(_indexed_hits(names, needs, fuzzy))
    hits = reduce(DataFrame.unionByName, parts)
    best = hits.groupBy("query").agg(F.min("tier").alias("tier"))
    hits = hits.join(best, ["query", "tier"], "left_semi").select("Name", "query", "tier")
    short = [(q,) for q in queries if not _words(q)]
    all_rows = meets.sparkSession.createDataFrame(short if fuzzy else [], "query string")
    direct = best.filter("tier = 1").select("query")
    return hits, all_rows.join(direct, "query", "left_anti")


def search_lifter(
    meets: DataFrame,
    names: str | Sequence[str] | DataFrame,
    fuzzy: bool = True,
    regex: bool = False,
) -> DataFrame:
    """Meet rows per searched name, with the match tier (1 direct, 2 words).

    ``names`` is a name, a list, or a table whose first column holds the names; any
    number of them.  Word matches count only for names without any direct match.  A
    name of short words only, without a direct match, finds every row, also rows
    without a name.

    The search runs over the different names of the meets; their rows join by equality.
    A short list is tested name by name.  A table, or a longer list, is joined on pieces of
    the names; the lengths of the pieces are collected when the query is built.

    With ``regex`` (lists only) an expression of a longer list is tested on the names that
    hold the text it needs, found by pieces of three letters; one that needs no such text is
    tested on every different name.  An expression whose words are not expressions by
    themselves has direct matches only.
    """
    if regex and isinstance(names, DataFrame):
        raise ValueError("regular expressions are given as a list")
    queries = None
    if not isinstance(names, DataFrame):
        listed = [names] if isinstance(names, str) else names
        queries = list(dict.fromkeys(q for q in listed if q is not None))
    for query in queries if regex else ():
        re.compile(query)
    if queries and (regex or len(queries) <= _PATTERNS):
        hits, all_rows = _pattern_hits(meets, queries, fuzzy, regex)
    else:
        hits, all_rows = _literal_hits(meets, _asked(meets, names), fuzzy)
    found = meets.join(hits, "Name").select(*meets.columns, "query", "tier")
    salts = F.sequence(F.lit(0), F.lit(_SALTS - 1))
    dealt = all_rows.distinct().select("query", F.explode(salts).alias("_salt"))
    salted = meets.withColumn("_salt", F.pmod(F.xxhash64(*meets.columns), F.lit(_SALTS)).cast("int"))
    everything = salted.join(dealt, "_salt").select(
        *meets.columns, "query", F.lit(2).alias("tier")
    )
    return found.unionByName(everything)


def lifter_meets(
    meets: DataFrame, names: str | Sequence[str] | DataFrame, **search
) -> DataFrame:
    """The meet list of each searched name by date: the listed columns that exist."""
    present = [c for c in MEET_COLUMNS if c in meets.columns]
    found = search_lifter(meets, names, **search).select("query", *present)
    return found.orderBy("query", *(["Date"] if "Date" in present else []))


def kg_to_lbs(meets: DataFrame) -> DataFrame:
    present = [c for c in MEET_WEIGHTS if c in meets.columns]
    return meets.withColumns(
        {
            c.replace("Kg", "Lbs"): F.bround(F.col(c) * LBS_PER_KG, 1)
            for c in present
        }
    )


def meets_long(meets: DataFrame, carry: Sequence[str] = ("athlete_id",)) -> DataFrame:
    """One row per successful lift, in the columns of the training log."""
    lbs = kg_to_lbs(meets)

    def optional(column: str, kind: str, absent=None) -> Column:
        source = F.col(column) if column in lbs.columns else F.lit(absent)
        return source.cast(kind)

    lifts = F.array(
        *[
            F.struct(
                F.lit(lift).alias("Lift_Type"),
                optional(f"Best3{lift}Lbs", "double").alias("Load"),
            )
            for lift in ("Squat", "Bench", "Deadlift")
        ]
    )
    kept = F.filter(lifts, lambda x: x["Load"] > 0)
    rows = lbs.select("*", F.explode(kept).alias("_lift"))
    lift = F.col("_lift.Lift_Type")
    blank = F.lit("")
    return rows.select(
        *carry,
        "Date",
        F.concat(
            F.lit("MEET: "),
            F.coalesce(optional("MeetName", "string", "Unknown Meet"), blank),
        ).alias("Block"),
        F.lit("Competition").alias("Day"),
        F.concat(F.lit("Competition "), lift).alias("Exercise"),
        F.lit(1.0).alias("Sets"),
        F.lit(1.0).alias("Reps"),
        F.col("_lift.Load").alias("Load"),
        F.lit(None).cast("double").alias("RPE"),
        F.concat(
            F.lit("Competition - "),
            F.coalesce(optional("Federation", "string"), blank),
            F.lit(" "),
            F.coalesce(optional("Division", "string"), blank),
        ).alias("Notes"),
        lift.alias("Lift_Type"),
        F.lit(True).alias("Meet_Result"),
        optional("Place", "string", "").alias("Place"),
        optional("TotalLbs", "double", 0.0).alias("Total"),
        optional("Dots", "double", 0.0).alias("Dots"),
    )


def integrate_meets(log: DataFrame, meet_rows: DataFrame | None) -> DataFrame:
    """Training rows flagged false, followed by the meet rows.

    Order is left to whoever writes or shows the result.
    """
    flagged = log.withColumn("Meet_Result", F.lit(False))
    if meet_rows is None:
        return flagged
    return flagged.unionByName(meet_rows, allowMissingColumns=True)


def meets_profile(meets: DataFrame) -> DataFrame:
    return meets.agg(
        F.count(F.lit(1)).alias("entries"),
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
        F.count_distinct("Federation").alias("federations"),
    )


def latest_meet(meets: DataFrame, by: Sequence[str] = ("Name",)) -> DataFrame:
    """Newest meet of each lifter with its name and total."""
    columns = ["MeetName", "TotalKg"]
    order = [F.desc_nulls_last("Date"), *[F.asc_nulls_last(c) for c in columns]]
    return top_rows(meets.select(*by, "Date", *columns), by, order)
