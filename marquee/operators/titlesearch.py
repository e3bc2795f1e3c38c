"""Search for many title patterns at once (P3 in batch form), by posting lists of grams.

One pattern is an ``ilike`` scan (``listings.show_listing``); thousands of
patterns against all shows that way would be a scan each.  Here every title stands
under its distinct grams (three, two and one letters in a row, lower case), as far as
some pattern asks for them.  A pattern takes the trigrams of its literal parts (the
bigrams or letters if no part is that long), and of those the rarest, by the number of
titles that have it, fetches candidates; only they are tested with the pattern itself.
A pattern without any letter ("%", "__") fetches every title: it is its length that decides.

The user's % and _ stay wildcards and a backslash escapes them, as in ``ilike``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.plans.lineage import materialize

LENGTHS = (3, 2, 1)
BLOCK = 1000  # ids of equal texts that lie in one array, about
PAIRS_PER_TASK, MOST_TASKS = 5_000_000, 10_000


def grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` letters of a text, lower case."""
    folded = F.lower(text)
    last = F.char_length(folded) - (n - 1)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(folded, i, F.lit(n)))
    return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def literal_parts(pattern: Column) -> Column:
    """The parts of a pattern between its wildcards, with escapes undone."""
    marked = F.regexp_replace(pattern, r"\\(.)", "\u0001$1")
    cut = F.regexp_replace(marked, "(?<!\u0001)[%_]", "\u0002")
    return F.split(F.regexp_replace(cut, "\u0001", ""), "\u0002")


def pattern_grams(pattern: Column) -> Column:
    """Grams that every text with this pattern has: of three letters if there are such, else of two, else of one, else the empty one."""
    parts = literal_parts(pattern)
    out = F.array(F.lit(""))
    for n in reversed(LENGTHS):
        own = F.array_distinct(F.flatten(F.transform(parts, lambda p, n=n: grams(p, n))))
        out = F.when(F.size(own) > 0, own).otherwise(out)
    return out


def show_search_batch(st: dict, patterns: DataFrame) -> DataFrame:
    """(pattern_id, show_id, title) for every pattern of ``patterns`` (pattern_id, pattern) and every show whose title
    holds it (``title ILIKE '%pattern%'``).  An empty or null pattern is no filter and matches nothing here.

    Equal titles and equal patterns are tested once.  The pairs, which copies grow by the square, are made last: the ids
    of a title and of a pattern, in arrays of about ``BLOCK``, are dealt to the tasks as blocks that are exploded there."""
    titles, asked = _titles(st), _asked(patterns)
    title_ids, pattern_ids = _blocks(titles, "title", "show_id"), _blocks(asked, "pattern", "pattern_id")
    found = materialize(_found(title_ids.select("title").distinct(), pattern_ids.select("pattern").distinct()), "search-found")
    sizes = [ids.groupBy(key).agg(F.sum(F.size("ids")).alias(n)) for ids, key, n in ((title_ids, "title", "n"), (pattern_ids, "pattern", "m"))]
    pairs = found.join(sizes[0], "title").join(sizes[1], "pattern").agg(F.sum(F.col("n").cast("double") * F.col("m"))).head()[0] or 0
    tasks = max(titles.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, int(pairs / PAIRS_PER_TASK)))
    blocks = (found.join(title_ids.withColumnsRenamed({"ids": "shows", "part": "show_part"}), "title").join(pattern_ids, "pattern")
              .repartition(tasks, "title", "pattern", "show_part", "part"))
    return (blocks.select("ids", "title", F.explode("shows").alias("s")).select(F.explode("ids").alias("p"), "s", "title")
            .select("p.pattern_id", "s.show_id", "title"))


def _titles(st: dict) -> DataFrame:
    return materialize(st["shows"].filter("title is not null").select("show_id", "title"), "search-titles")


def _asked(patterns: DataFrame) -> DataFrame:
    return materialize(patterns.filter("pattern is not null and pattern <> ''").select("pattern_id", "pattern"), "search-patterns")


def _blocks(rows: DataFrame, key: str, col: str) -> DataFrame:
    """(key, part, ids): the ids of each text of a written table, as structs (an id may be null or repeat), in parts of about ``BLOCK``."""
    parts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).join(parts, key).withColumn("part", F.pmod("_row", "_parts"))
    return materialize(dealt.groupBy(key, "part").agg(F.collect_list(F.struct(col)).alias("ids")), f"search-{key}-ids")


def _found(titles: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, title) of the distinct ``patterns`` (pattern) and the distinct ``titles`` (title) that hold them."""
    titles = materialize(titles.withColumn("_title", F.monotonically_increasing_id()), "search-title-classes")
    asked = materialize(patterns.select("pattern", F.explode(pattern_grams(F.col("pattern"))).alias("gram")), "search-grams")
    own = titles.select("_title", F.explode(F.array_union(F.concat(*[grams(F.col("title"), n) for n in LENGTHS]), F.array(F.lit("")))).alias("gram"))
    postings = materialize(own.join(asked.select("gram").distinct(), "gram", "left_semi"), "search-postings")
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("titles"))
    rarest = (asked.join(counts, "gram", "left").groupBy("pattern")
              .agg(F.min(F.struct(F.coalesce("titles", F.lit(0)).alias("titles"), "gram")).alias("r")).select("pattern", "r.gram"))
    candidates = rarest.join(postings, "gram").join(titles, "_title")
    return candidates.filter("title ILIKE concat('%', pattern, '%')").select("pattern", "title")


def search_classes(st: dict, patterns: DataFrame) -> DataFrame:
    """``show_search_batch`` without expanding copies: equal patterns are one class, equal titles are one class.

    (kind, member_id, pattern_id, pattern, show_id, title), a class being named by its text and its smallest id: kind
    ``match``, a row per pattern class and title class that it finds; ``pattern`` and ``show``, a row per pattern and show
    (member_id) with its class.  Joined by class they give every pair of a pattern and a show."""
    titles, asked = _titles(st), _asked(patterns)
    title_classes = materialize(titles.groupBy("title").agg(F.min("show_id").alias("show_id")), "search-title-classes")
    classes = materialize(asked.groupBy("pattern").agg(F.min("pattern_id").alias("pattern_id")), "search-pattern-classes")
    none = F.lit(None)
    match = _found(title_classes.select("title"), classes.select("pattern")).join(title_classes, "title").join(classes, "pattern").select(
        F.lit("match").alias("kind"), none.cast("long").alias("member_id"), "pattern_id", "pattern", "show_id", "title")
    of_pattern = asked.select(F.col("pattern_id").alias("member_id"), "pattern").join(classes, "pattern").select(
        F.lit("pattern").alias("kind"), "member_id", "pattern_id", "pattern", none.cast("long").alias("show_id"), none.cast("string").alias("title"))
    of_show = titles.select(F.col("show_id").alias("member_id"), "title").join(title_classes, "title").select(
        F.lit("show").alias("kind"), "member_id", none.cast("long").alias("pattern_id"), none.cast("string").alias("pattern"), "show_id", "title")
    return match.unionByName(of_pattern).unionByName(of_show)
