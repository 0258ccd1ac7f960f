"""Fuzzy project matching: word containment, best word subset, similarity ranking."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from worklens import vocab
from worklens.functions.text import strip
from worklens.functions.values import clean_value, percent_text
from worklens.functions.words import meaningful_words, name_similarity
from worklens.scale import join_in_parts, number_rows
from worklens.session import written

GRAM = 3
#: Numbers of 64 bits in the bitmap of a name's characters.
BIT_LANES = 4
#: Rows of one key on the larger side of a join that one task takes.
HOT_ROWS = 1 << 14


def _grams(c: Column, size: int) -> Column:
    """Distinct substrings of a fixed length."""
    last = F.length(c) - size + 1
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(c, i, F.lit(size)))
    )


def contains_join(terms: DataFrame, texts: DataFrame, term: str, text: str) -> DataFrame:
    """Pairs of distinct terms and distinct texts where the text contains the term.

    Every term is looked up by its rarest gram only (the gram found in the
    fewest texts), then the pair is verified, so the candidates of a term are
    bounded by its least common part. Grams that no term asks for are dropped
    where the texts are read. Both frames have one column.
    """
    wanted = terms.select(term).distinct().filter(F.length(term) > 0)
    known = texts.select(text).distinct()
    size = F.least(F.length(term), F.lit(GRAM))
    term_grams = wanted.select(term, F.explode(_grams_of(F.col(term), size)).alias("_gram"))
    # Only gram lengths that some term has: at most GRAM numbers.
    sizes = sorted(r[0] for r in wanted.select(size.cast("int")).distinct().collect())
    if not sizes:
        return wanted.join(known.withColumnRenamed(text, "_t"), F.lit(False)).select(term, F.col("_t").alias(text))
    grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col(text), n) for n in sizes])))
    asked = term_grams.select("_gram").distinct()
    counted = known.select(F.explode(grams).alias("_gram")).join(asked, "_gram", "left_semi")
    in_texts = counted.groupBy("_gram").agg(F.count(F.lit(1)).alias("_texts"))
    # A gram without texts proves that the term is nowhere: count it as zero.
    scored = term_grams.join(in_texts, "_gram", "left").fillna(0, ["_texts"])
    anchor = scored.groupBy(term).agg(F.min_by("_gram", F.struct("_texts", "_gram")).alias("_gram"))
    # Written: its size decides whether the texts must be shuffled to meet it.
    anchor = written(anchor, "anchors")
    held = known.select(text, F.explode(grams).alias("_gram")).join(anchor.select("_gram").distinct(), "_gram", "left_semi")
    return anchor.join(held, "_gram").filter(F.col(text).contains(F.col(term))).select(term, text)


def _grams_of(c: Column, size: Column) -> Column:
    last = F.length(c) - size + 1
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(c, i, size)))


def word_titles(words: DataFrame, projects: DataFrame) -> DataFrame:
    """Pairs of lower-cased words and titles: ``word`` in ``title``."""
    lowered = words.select(F.lower("word").alias("word"))
    titles = projects.select(F.lower("project_title").alias("title"))
    return contains_join(lowered, titles, "word", "title")


def _title_sizes(projects: DataFrame, live: Column) -> DataFrame:
    return projects.groupBy(F.lower("project_title").alias("title")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.coalesce(live, F.lit(False))).alias("_live")
    )


def _word_statistics(words: DataFrame, pairs: DataFrame, cap: int | None) -> DataFrame:
    """Hit count, counted up to the cap if there is one, and live titles of every word; pairs carry ``_n`` and ``_live``."""
    counted = pairs.groupBy("word").agg(F.sum("_n").alias("_n"), F.count_if("_live").alias("_titles"))
    every = words.select(F.lower("word").alias("word")).distinct().join(counted, "word", "left")
    hits = F.coalesce("_n", F.lit(0))
    hits = (hits if cap is None else F.least(hits, F.lit(cap))).cast("int")
    return every.select("word", hits.alias("hits"), F.coalesce("_titles", F.lit(0)).alias("_titles"))


def hit_counts(words: DataFrame, projects: DataFrame, cap: int | None = None) -> DataFrame:
    """Projects whose title contains each word, any date and state; up to the cap if one is given."""
    pairs = word_titles(words, projects).join(_title_sizes(projects, F.lit(True)), "title")
    return _word_statistics(words, pairs, cap).drop("_titles")


def is_eligible(start_date: str = vocab.PROJECT_START_DATE) -> Column:
    return (F.col("state") == "active") & (F.col("created_date") >= start_date)


def similar_texts(names: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (name, text) whose ratio can reach the threshold: those with enough common characters."""
    overlap = F.size(F.array_intersect("_name_tokens", "_text_tokens"))
    needed = F.ceil((F.col("_name_n") + F.col("_text_n")) * (threshold / 2) - 1e-9)
    return similar_candidates(names, texts, threshold).filter(overlap >= needed).select("name", "text")


def similar_candidates(names: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The rows that leave the join behind ``similar_texts``; no pair with enough common characters is missing.

    The ratio is at most ``2 * common characters / total length``. With texts seen as sets of
    numbered characters (``e1``, ``e2``, ...), a pair that reaches the threshold shares one of the
    rarest such tokens of both. How many have to be looked at depends on the lengths, so both
    sides are joined by length bands as well: the closer the lengths, the fewer. Inside the join the
    places of the shared token and a bitmap of each set bound the common characters, so that hardly a
    row leaves it that does not qualify; a pair leaves it at its first shared token only.
    """
    # Partners' lengths differ by less than this factor; three bands cover it.
    widest = (2 - threshold) / threshold
    width = math.log(widest) / 3

    def band_of(length: Column) -> Column:
        return F.floor(F.log(length.cast("double")) / width + 1e-9).cast("int")

    def tokens(df: DataFrame, name: str) -> DataFrame:
        characters = F.array_sort(F.split(F.lower(F.col(name)), ""))
        runs = F.transform(
            characters, lambda ch, i: F.concat(ch, (i - F.array_position(characters, ch) + 2).cast("string"))
        )
        return df.select(name).distinct().filter(F.length(name) > 0).select(name, runs.alias("_tokens"))

    left, right = tokens(names, "name"), tokens(texts, "text")
    common = right.select(F.explode("_tokens").alias("_token")).groupBy("_token").agg(F.count(F.lit(1)).alias("_df"))

    def prefixes(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        """Rows (token, band of the name, band of the text) with what the filters need."""
        rows = df.select(name, F.explode("_tokens").alias("_token")).join(common, "_token", "left").fillna(0, ["_df"])
        # At most one row per character of the text: the array is as long as the text.
        ranked = rows.groupBy(name).agg(
            F.array_sort(F.collect_list(F.struct("_df", "_token"))).alias("_r"),
            *[F.bit_or(_bit(lane)).alias(f"_{name}_bits{lane}") for lane in range(BIT_LANES)],
        )
        n = F.size("_r")
        ranked = ranked.withColumns({f"_{name}_n": n, own: band_of(n), f"_{name}_tokens": F.transform("_r", lambda r: r["_token"])}).drop("_r")
        each = ranked.withColumn(other, F.explode(F.sequence(F.col(own) - 4, F.col(own) + 4)))
        n = F.col(f"_{name}_n")
        # The shortest partner in a band needs the fewest common characters.
        shortest = F.greatest(F.ceil(F.exp(F.col(other) * width) - 1e-6), F.ceil(n / widest - 1e-9), F.lit(1))
        longest = F.floor(F.exp((F.col(other) + 1) * width) + 1e-6)
        each = each.filter((F.col(other) >= 0) & (shortest <= n * widest + 1e-9) & (longest * widest + 1e-9 >= n))
        needed = F.greatest(F.ceil((n + shortest) * (threshold / 2) - 1e-9), F.lit(1))
        keep = F.greatest(n - needed + 1, F.lit(1)).cast("int")
        each = each.withColumn(f"_{name}_prefix", F.slice(f"_{name}_tokens", F.lit(1), keep))
        return each.select("*", F.posexplode(f"_{name}_prefix").alias(f"_{name}_at", "_token"))

    a = prefixes(left, "name", "_name_band", "_text_band")
    b = written(prefixes(right, "text", "_text_band", "_name_band"), "text-prefixes")
    keys = ["_token", "_name_band", "_text_band"]
    n, m = F.col("_name_n"), F.col("_text_n")
    needed = F.ceil((n + m) * (threshold / 2) - 1e-9)
    placed = F.least("_name_at", "_text_at") + 1 + F.least(n - F.col("_name_at") - 1, m - F.col("_text_at") - 1)

    def lacking(x: str, y: str) -> Column:
        """Slices that only one set falls into: so many of its characters at least are not common."""
        lanes = [F.bit_count(F.col(f"_{x}_bits{i}").bitwiseAND(F.bitwise_not(F.col(f"_{y}_bits{i}")))) for i in range(BIT_LANES)]
        return reduce(lambda total, lane: total + lane, lanes)

    most = F.least(n - lacking("name", "text"), m - lacking("text", "name"))
    first = F.try_element_at(F.array_intersect("_name_prefix", "_text_prefix"), F.lit(1))
    bound = (F.least(n, m) >= needed) & (placed >= needed) & (most >= needed) & (F.col("_token") == first)
    return join_in_parts(a, b, keys, HOT_ROWS).filter(bound)


def _bit(lane: int) -> Column:
    """The bit of the slice of ``_token`` in one of the numbers of a bitmap."""
    slot = f"pmod(xxhash64(_token), {64 * BIT_LANES})"
    return F.expr(f"if({slot} div 64 = {lane}, shiftleft(1L, cast({slot} % 64 as int)), 0L)")


def best_word_sets(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """(_list, _found, _set): for each list of words the sets that hold most of them, two or more at least.

    lists: _list, words in order of preference, repeated words counted each. sets: _set, distinct words.
    ``_found`` are the places of the words in the list; of equally many the first in order win.

    An inverted index on word *pairs* takes the place of one on words, so a word that
    a large share of the sets hold is met only together with another one. The pairs that exist at all
    bound how many words a set can hold that begins with a pair: each list looks first
    where most can be reached, and then only where more, or as many earlier ones, still can be.
    """
    lists = lists.select("_list").distinct().filter(F.size("_list") > 1)
    last = F.size("_list") - 1

    def pair(i: Column, j: Column) -> Column:
        x, y = F.get("_list", i), F.get("_list", j)
        return F.struct(i.alias("i"), j.alias("j"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    ahead = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda j: pair(i, j))))
    asked = lists.select("_list", F.explode(ahead).alias("_pair")).select("_list", "_pair.*")
    # A list with a repeated word asks for the pair of the word with itself.
    within = F.flatten(F.transform("_set", lambda x: F.transform(F.filter("_set", lambda y: y >= x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    index = sets.select("_set").distinct().select("_set", F.explode(within).alias("_pair")).select("_set", "_pair.*")
    index = written(index.join(asked.select("a", "b").distinct(), ["a", "b"], "left_semi"), "pair-index")
    known = index.select("a", "b").distinct()
    there = written(asked.join(known, ["a", "b"]), "pairs-there")

    # The pairs of one list: at most as many as its words squared.
    marks = there.groupBy("_list").agg(F.collect_list(F.struct("i", "j")).alias("_there"))
    there = there.join(marks, "_list")

    def exists(i: Column, j: Column) -> Column:
        return F.array_contains("_there", F.struct(i.alias("i"), j.alias("j")))

    later = F.when(F.col("j") < last, F.sequence(F.col("j") + 1, last)).otherwise(F.array().cast("array<int>"))
    reach = F.size(F.filter(later, lambda k: exists(F.col("i"), k) & exists(F.col("j"), k))) + 2
    there = written(there.select("_list", "i", "j", "a", "b", reach.alias("_reach")), "pair-bounds")

    found = F.filter(F.transform("_list", lambda w, i: F.when(F.array_contains("_set", w), i)), lambda i: i.isNotNull())

    def looked_up(pairs: DataFrame) -> DataFrame:
        return join_in_parts(pairs, index, ["a", "b"], HOT_ROWS).select("_list", "i", "j", "_set", found.alias("_found"))

    most = there.groupBy("_list").agg(F.min(F.struct((-F.col("_reach")).alias("r"), "i", "j", "a", "b")).alias("_pair"))
    first = written(looked_up(most.select("_list", "_pair.i", "_pair.j", "_pair.a", "_pair.b")), "pair-candidates")
    best = F.min(F.struct((-F.size("_found")).alias("s"), F.col("_found").alias("f"))).alias("_best")
    held = first.groupBy("_list").agg(best).select("_list", F.get("_best.f", F.lit(0)).alias("_i"), F.get("_best.f", F.lit(1)).alias("_j"), (-F.col("_best.s")).alias("_held"))
    left = there.join(most.select("_list", F.col("_pair.i").alias("_pi"), F.col("_pair.j").alias("_pj")), "_list").join(held, "_list")
    earlier = F.struct("i", "j") <= F.struct(F.col("_i").alias("i"), F.col("_j").alias("j"))
    open_ = (F.col("_reach") > F.col("_held")) | ((F.col("_reach") == F.col("_held")) & earlier)
    left = left.filter(open_ & ~((F.col("i") == F.col("_pi")) & (F.col("j") == F.col("_pj")))).select("_list", "i", "j", "a", "b")
    # A set is met at the first two of its words that the list has.
    begins = (F.get("_found", F.lit(0)) == F.col("i")) & (F.get("_found", F.lit(1)) == F.col("j"))
    rest = written(looked_up(left).filter(begins), "pair-candidates")
    every = first.unionByName(rest).select("_list", "_set", "_found")
    winner = every.groupBy("_list").agg(best).select("_list", F.col("_best.f").alias("_found"))
    return every.join(winner, ["_list", "_found"]).distinct()


def match_projects(
    enquiries: DataFrame,
    projects: DataFrame,
    *,
    start_date: str = vocab.PROJECT_START_DATE,
    threshold: float = vocab.SIMILARITY_THRESHOLD,
    counts: DataFrame | None = None,
    hit_cap: int | None = None,
) -> DataFrame:
    """All matching projects of every enquiry with their similarity.

    enquiries: enquiry_id, project_name. projects: item_id, project_reference,
    project_title, state, created_date. counts: optional recorded ``word, hits``.
    ``hit_cap`` makes all words with more hits alike, as a paged count does.

    The largest set of enquiry words found together in a title wins; among sets
    of that size the one with the rarest words (by hit count, then text order).
    That set is found without trying subsets, see ``best_word_sets``; the matches are
    the titles that hold exactly its words of the name.
    """
    rows = enquiries.select(
        "enquiry_id", "project_name", meaningful_words("project_name").alias("_words")
    )
    worded = rows.filter(F.size("_words") > 0)
    each = worded.select("enquiry_id", F.posexplode("_words").alias("_pos", "_word")).withColumn("word", F.lower("_word"))
    live = projects.filter(is_eligible(start_date)).withColumn("title", F.lower("project_title"))
    # Written once: the statistics and both lookups below read it.
    pairs = written(
        word_titles(each, projects).join(_title_sizes(projects, is_eligible(start_date)), "title"), "word-titles"
    )
    statistics = _word_statistics(each, pairs, hit_cap)
    pairs = pairs.filter("_live").select("word", "title")
    if counts is not None:
        recorded = counts.select(F.lower("word").alias("word"), "hits")
        statistics = statistics.drop("hits").join(recorded, "word", "left")
    ranked = each.join(statistics, "word").withColumn("hits", F.coalesce("hits", F.lit(vocab.UNKNOWN_HIT_COUNT)))
    # Words of one name: the array is as long as the name.
    ordered = ranked.groupBy("enquiry_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("hits", "_pos", "word", "_titles"))),
            lambda w: F.struct(w["word"].alias("word"), w["_titles"].alias("titles")),
        ).alias("_ordered")
    )
    ordered = written(ordered.withColumn("_list", F.transform("_ordered", lambda w: w["word"])), "ordered-words")

    # Titles with the same enquiry words are alike here: only winning sets are expanded to titles.
    # The words of one title are at most as many as its characters.
    sets = written(pairs.groupBy("title").agg(F.array_sort(F.collect_set("word")).alias("_set")), "title-words")
    winners = written(best_word_sets(ordered, sets).select("_list", "_set"), "winning-sets")
    by_set = ordered.select("enquiry_id", "_list").join(winners, "_list").join(sets, "_set").select("enquiry_id", "title")

    # Otherwise one word: the first in order that any live title contains.
    single = ordered.join(winners.select("_list"), "_list", "left_anti").select(
        "enquiry_id", F.try_element_at(F.filter("_ordered", lambda w: w["titles"] > 0), F.lit(1))["word"].alias("word")
    )
    by_word = single.filter("word is not null").join(pairs, "word").select("enquiry_id", "title")

    titles = by_set.unionByName(by_word).withColumn("method", F.lit("words"))
    detail = ["item_id", "project_reference", "project_title", "state", "created_date"]

    # No usable word: the whole name, as text.
    wordless = rows.filter(F.size("_words") == 0).withColumn("_name", F.lower(strip("project_name")))
    if not wordless.isEmpty():
        whole = contains_join(wordless.select("_name"), live.select("title"), "_name", "title")
        by_name = wordless.join(whole, "_name").select("enquiry_id", "title", F.lit("full_text").alias("method"))
        titles = titles.unionByName(by_name)
    titles = written(titles, "matched-titles")
    every = titles.join(live.select("title", *detail), "title").drop("title")

    # Words, but in no live title: every live project that is similar enough.
    lost = worded.join(titles.select("enquiry_id"), "enquiry_id", "left_anti").select("enquiry_id", "project_name")
    if not lost.isEmpty():
        every = every.unionByName(_similar_projects(lost, live.select(*detail), threshold))
    every = every.join(enquiries.select("enquiry_id", "project_name"), "enquiry_id")
    # The ratios cost time, not bytes: spread the pairs so that no task gets a whole hot enquiry.
    every = every.repartition(int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")), "enquiry_id", "item_id")
    similarity = name_similarity("project_name", "project_reference", "project_title")
    scored = every.withColumn("similarity", similarity)
    return scored.filter((F.col("method") != "similarity") | (F.col("similarity") >= threshold))


def _similar_projects(lost: DataFrame, live: DataFrame, threshold: float) -> DataFrame:
    """Live projects that can be similar enough to a name, by reference or title."""
    names = lost.withColumn("name", F.lower("project_name"))
    shown = live.select("item_id", F.explode(F.array(F.lower("project_reference"), F.lower("project_title"))).alias("text"))
    near = similar_texts(names.select("name"), shown.select("text"), threshold)
    pairs = names.join(near, "name").join(shown, "text").select("enquiry_id", "item_id").distinct()
    return pairs.join(live, "item_id").withColumn("method", F.lit("similarity"))


def rank_candidates(matches: DataFrame) -> DataFrame:
    """Candidates of every enquiry from the most similar on, ranked from 1.

    An enquiry can match a large share of the projects, so ranks are assigned
    slice by slice.
    """
    order = [F.col("similarity").desc(), F.col("item_id")]
    # Ranging samples its input, so the ratios are written down first.
    ranked = number_rows(written(matches, "matches"), ["enquiry_id"], order, "rank")
    return ranked.withColumn("match_percentage", percent_text("similarity"))


def match_contracts(enquiries: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per enquiry: does a match exist, which is best, how many."""
    best = ranked.groupBy("enquiry_id").agg(
        F.count(F.lit(1)).cast("int").alias("candidate_count"),
        F.min_by(F.struct("item_id", "project_reference", "project_title", "similarity"), "rank").alias("best_match"),
    )
    df = enquiries.select("enquiry_id", "project_name").join(best, "enquiry_id", "left")
    exists = F.col("best_match").isNotNull()
    return df.select(
        "enquiry_id",
        F.col("project_name").alias("extracted_project_title"),
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        exists.alias("exists"),
        F.when(exists, F.lit("existing")).otherwise("new").alias("match_type"),
        "best_match",
        F.coalesce("best_match.similarity", F.lit(0.0)).alias("similarity_score"),
    )


def match_report(contracts: DataFrame, ranked: DataFrame, companies: DataFrame) -> DataFrame:
    """Report rows: title and company of the enquiry next to every candidate.

    companies: enquiry_id, company (raw extracted value).
    """
    company = F.coalesce(F.nullif(clean_value("company"), F.lit("")), F.lit("Not found"))
    heads = contracts.join(companies, "enquiry_id", "left").select(
        "enquiry_id",
        F.coalesce(F.nullif("extracted_project_title", F.lit("")), F.lit("Not found")).alias("extracted_project_title"),
        company.alias("extracted_company"),
    )
    rows = ranked.select(
        "enquiry_id", "rank", "item_id", "project_reference", "project_title", "similarity", "match_percentage", "created_date"
    )
    return heads.join(rows, "enquiry_id", "left")
