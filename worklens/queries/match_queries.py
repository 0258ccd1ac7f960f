"""Queries over project matching, with part names as project titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklens import vocab
from worklens.operators import matching
from worklens.queries.base import Proxy, query, table
from worklens.session import written

PROJECTS = Proxy(
    "part",
    {
        "item_id": "cast(p_partkey as string)",
        "project_reference": "concat('TP', cast(p_partkey as string))",
        "project_title": "concat(p_name, ' ', p_brand)",
        "state": "case when p_size % 4 = 0 then 'archived' else 'active' end",
        "created_date": "case when p_size % 7 = 0 then '2019-05-01' else '2023-05-01' end",
    },
)
ENQUIRIES = Proxy(
    "part",
    {
        "enquiry_id": "concat(p_name, '/', p_type)",
        "project_name": "concat('The ', p_name, ' at ', p_type, ' ', p_name, ' 12B')",
    },
)
_WORDS = f"""
    select enquiry_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from (select distinct enquiry_id,
      list_filter(string_split(lower(project_name), ' '), lambda x: x not in ('the', 'at', '12b')) as w from {ENQUIRIES.sql})
    """
_HITS = f"""select word, least(50, (select count(*) from {PROJECTS.sql} p where contains(lower(p.project_title), word)))::int as hits from (select distinct word from ({_WORDS}))"""


def _enquiries(spark, sf):
    return ENQUIRIES.df(spark, sf).distinct()


def _words(spark, sf):
    from worklens.functions.words import meaningful_words

    return _enquiries(spark, sf).select(F.explode(meaningful_words("project_name")).alias("word"))


def _matched(spark, sf):
    # The order of the words follows the stored, capped counts.
    return matching.match_projects(_enquiries(spark, sf), PROJECTS.df(spark, sf), hit_cap=vocab.HIT_COUNT_CAP)


@query("word_hit_counts", _HITS)
def word_hit_counts(spark, sf):
    return matching.hit_counts(_words(spark, sf), PROJECTS.df(spark, sf), vocab.HIT_COUNT_CAP)


@query(
    "word_containment",
    f"""
    select distinct w.word, lower(p.project_title) as title from (select distinct word from ({_WORDS})) w join {PROJECTS.sql} p on contains(lower(p.project_title), w.word)
    """,
)
def word_containment(spark, sf):
    return matching.word_titles(_words(spark, sf), PROJECTS.df(spark, sf))


@query(
    "full_text_containment",
    f"select distinct lower(b.p_name) as name, lower(p.project_title) as title from (select distinct p_name from part) b join {PROJECTS.sql} p on contains(lower(p.project_title), lower(b.p_name))",
)
def full_text_containment(spark, sf):
    names = table(spark, sf, "part").select(F.lower("p_name").alias("name"))
    titles = PROJECTS.df(spark, sf).select(F.lower("project_title").alias("title"))
    return matching.contains_join(names, titles, "name", "title")


_MATCHES = f"""
    with w as ({_WORDS}), h as ({_HITS}), r as (select enquiry_id, w.word, row_number() over (partition by enquiry_id order by h.hits, w.pos) as i from w join h using (word)),
    live as (select * from {PROJECTS.sql} where state = 'active' and created_date >= '2021-01-01'),
    titles as (select distinct lower(project_title) as title from live),
    -- Words and titles meet once, not once for every enquiry.
    wt as materialized (select word, title from (select distinct word from w) v join titles on contains(title, word)),
    f as (select r.enquiry_id, wt.title, list(r.i order by r.i) as found from r join wt using (word) group by 1, 2),
    b as (select *, row_number() over (partition by enquiry_id order by len(found) desc, found) as rn from f),
    m as (select f.enquiry_id, f.title from f join b on b.enquiry_id = f.enquiry_id and b.rn = 1 and b.found = f.found)
    select m.enquiry_id, l.item_id from m join live l on lower(l.project_title) = m.title
    """


@query("project_matches", _MATCHES)
def project_matches(spark, sf):
    return _matched(spark, sf).select("enquiry_id", "item_id")


@query("ranked_project_candidates")
def ranked_project_candidates(spark, sf):
    """Ranked candidates with their percentage; the similarity has no SQL equivalent."""
    ranked = matching.rank_candidates(_matched(spark, sf))
    return ranked.select("enquiry_id", "rank", "item_id", F.round("similarity", 6).alias("similarity"), "match_percentage")


@query("similar_name_fallback")
def similar_name_fallback(spark, sf):
    """Names with a typing error in every word: found by similarity only."""
    damaged = F.translate("p_name", "aeo", "xyz")
    enquiries = table(spark, sf, "part").select(F.col("p_name").alias("enquiry_id"), damaged.alias("project_name")).distinct()
    matches = matching.match_projects(enquiries, PROJECTS.df(spark, sf))
    return matches.select("enquiry_id", "item_id", "method", F.round("similarity", 6).alias("similarity"))


@query(
    "match_contracts",
    f"""
    with m as ({_MATCHES}), e as (select distinct enquiry_id, project_name from {ENQUIRIES.sql})
    select e.enquiry_id, e.project_name as extracted_project_title, count(m.item_id)::int as candidate_count, count(m.item_id) > 0 as exists,
      case when count(m.item_id) > 0 then 'existing' else 'new' end as match_type from e left join m using (enquiry_id) group by 1, 2
    """,
)
def match_contracts(spark, sf):
    enquiries = _enquiries(spark, sf)
    ranked = matching.rank_candidates(_matched(spark, sf))
    return matching.match_contracts(enquiries, ranked).drop("best_match", "similarity_score")


@query(
    "best_matches",
    f"with m as ({_MATCHES}) select distinct enquiry_id, true as is_first, true as is_highest from m",
)
def best_matches(spark, sf):
    """The best match of every contract is the first ranked candidate, and none is more similar."""
    ranked = written(matching.rank_candidates(_matched(spark, sf)), "ranked")
    contracts = matching.match_contracts(_enquiries(spark, sf), ranked).filter("exists")
    first = ranked.filter("rank = 1").select("enquiry_id", "item_id", "similarity")
    highest = ranked.groupBy("enquiry_id").agg(F.max("similarity").alias("highest"))
    same = (F.col("best_match.item_id") == F.col("item_id")) & (F.col("similarity_score") == F.col("similarity"))
    joined = contracts.join(first, "enquiry_id").join(highest, "enquiry_id")
    return joined.select("enquiry_id", same.alias("is_first"), (F.col("similarity_score") == F.col("highest")).alias("is_highest"))


@query(
    "match_report",
    f"""
    with m as ({_MATCHES}), e as (select distinct enquiry_id, project_name from {ENQUIRIES.sql})
    select e.enquiry_id, e.project_name as extracted_project_title, case when length(e.enquiry_id) % 2 = 0 then 'Roofs' else 'Not found' end as extracted_company, m.item_id
    from e left join m using (enquiry_id)
    """,
)
def match_report(spark, sf):
    """Title and company of every enquiry next to each of its candidates; half of the companies are known."""
    enquiries = _enquiries(spark, sf)
    ranked = matching.rank_candidates(_matched(spark, sf))
    company = F.when(F.length("enquiry_id") % 2 == 0, F.lit(': "Roofs"')).otherwise(F.lit(" "))
    companies = enquiries.select("enquiry_id", company.alias("company"))
    report = matching.match_report(matching.match_contracts(enquiries, ranked), ranked, companies)
    return report.select("enquiry_id", "extracted_project_title", "extracted_company", "item_id")
