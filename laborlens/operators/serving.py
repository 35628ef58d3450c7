"""Filters, joins and lists behind the feed, the tracker and the admin screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from .skew import latest, rank_in_group, salted_join

LIVE = ("published", "pending_review")


def is_matchable() -> Column:
    return (F.col("status") == "published") & F.col("is_golden")


def moderation_tab(tab: str) -> Column:
    status = F.col("status")
    return {
        "published": status == "published",
        "review": (status == "pending_review") | F.col("needs_review"),
        "expired": status == "expired",
        "rejected": status.isin("rejected", "archived"),
    }[tab]


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Current state per user and posting; a last ``unsaved`` means no state."""
    last = latest(feedback, ["user_id", "job_id"], ["created_at", "event_id"], ["type"])
    return last.select("user_id", "job_id", F.nullif("type", F.lit("unsaved")).alias("feedback"))


def feed(matches: DataFrame, jobs: DataFrame, companies: DataFrame, feedback: DataFrame) -> DataFrame:
    """Matches of published postings with company name and current feedback."""
    live = jobs.filter(F.col("status") == "published").select(
        "job_id", "title", "city", "remote_policy", "salary_min", "salary_max", "date_posted",
        "hiring_name", "company_id",
    )
    names = companies.select("company_id", F.col("name").alias("_company"))
    rows = matches.join(live, "job_id").join(names, "company_id", "left")
    rows = rows.withColumn("company_name", F.coalesce("_company", "hiring_name")).drop(
        "_company", "hiring_name", "company_id"
    )
    state = latest_feedback(feedback).filter(F.col("feedback").isNotNull())
    return rows.join(state, ["user_id", "job_id"], "left").withColumn("is_new", F.col("seen_at").isNull())


def in_view(view: str) -> Column:
    state = F.col("feedback")
    if view == "saved":
        return state.isin("saved", "applied")
    if view == "dismissed":
        return state == "dismissed"
    return state.isNull() | (state != "dismissed")


def filter_feed(
    rows: DataFrame, view: str = "all", show_hidden: bool = False, labels: tuple = (),
    remote: str | None = None, needle: str | None = None,
) -> DataFrame:
    out = rows.filter(in_view(view))
    if not show_hidden:
        out = out.filter(~F.col("knocked_out"))
    if labels:
        out = out.filter(F.col("label").isin(*labels))
    if remote:
        out = out.filter(F.col("remote_policy") == remote)
    if needle:
        blank = F.lit("")
        hay = F.lower(F.concat_ws(" ", "title", F.coalesce("company_name", blank), F.coalesce("city", blank)))
        out = out.filter(hay.contains(needle.lower()))
    return out


def sort_feed(rows: DataFrame, by: str = "score") -> DataFrame:
    """Position in the user's list: knocked out last, then score, date or pay, newest first."""
    pay = F.coalesce("salary_max", "salary_min", F.lit(0.0))
    key = {
        "score": -F.col("total_score"),
        "new": -F.coalesce(F.unix_date("date_posted"), F.lit(0)).cast("double"),
        "salary": -pay,
    }[by]
    bucket = F.struct(F.col("knocked_out").alias("k"), F.floor(key).alias("b"))
    order = [F.col("knocked_out"), key, F.col("job_id")]
    return rank_in_group(rows, ["user_id"], bucket, order, "place")


def feed_counters(rows: DataFrame, view: str = "all") -> DataFrame:
    """Hidden rows of the view; the other counters over all rows of the user."""
    shown = ~F.col("knocked_out")
    return rows.groupBy("user_id").agg(
        F.count_if(in_view(view) & F.col("knocked_out")).alias("hidden"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_new") & shown).alias("new"),
        F.count_if(shown & F.coalesce(F.col("feedback") != "dismissed", F.lit(True))).alias("visible"),
        F.count_if((F.col("label") == "strong") & shown).alias("strong"),
    )


def match_detail(pairs, jobs, companies, matches, applications, feedback) -> DataFrame:
    """Posting facts, score, application and feedback for every asked pair."""
    facts = jobs.select("job_id", "title", "company_id", "status").withColumnRenamed("status", "job_status")
    names = companies.select("company_id", F.col("name").alias("company_name"))
    scores = matches.select("user_id", "job_id", "total_score", "label", "knocked_out")
    apps = applications.select("user_id", "job_id", "application_id", F.col("status").alias("application_status"))
    key = ["user_id", "job_id"]
    return (
        pairs.select(*key).join(facts, "job_id").join(names, "company_id", "left").drop("company_id")
        .join(scores, key, "left").join(apps, key, "left").join(latest_feedback(feedback), key, "left")
    )


def tracker(applications: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    facts = jobs.select("job_id", "title", "city", "company_id", "hiring_name")
    names = companies.select("company_id", F.col("name").alias("_company"))
    rows = applications.join(facts, "job_id", "left").join(names, "company_id", "left")
    return rows.select(
        "application_id", "user_id", "job_id", "status", "position",
        F.coalesce("title", F.lit("–")).alias("title"),
        F.coalesce("_company", "hiring_name", F.lit("")).alias("company"), "city",
    )


def renumber(applications: DataFrame) -> DataFrame:
    """0-based positions within a user's column, keeping the present order."""
    out = rank_in_group(
        applications, ["user_id", "status"], F.col("position"),
        [F.col("position"), F.col("application_id")], "_r",
    )
    return out.withColumn("new_position", F.col("_r") - 1).drop("_r")


def visible_jobs(jobs: DataFrame, matches: DataFrame, applications: DataFrame) -> DataFrame:
    """Postings a user can reach: published golden, or matched, or applied for."""
    reached = matches.select("user_id", "job_id").unionByName(applications.select("user_id", "job_id")).distinct()
    return jobs.join(reached.select("job_id").distinct(), "job_id", "left_semi").unionByName(
        jobs.filter(is_matchable()).join(reached.select("job_id").distinct(), "job_id", "left_anti")
    )


def skill_labels(uses: DataFrame, skills: DataFrame, locale: str) -> DataFrame:
    """Label of each used skill: Dutch when asked for, then English, then the stored one, then the uri."""
    names = skills.select("uri", "label_en", "label_nl")
    nl = F.col("label_nl") if locale == "nl" else F.lit(None).cast("string")
    picked = F.coalesce(nl, "label_en", "label", F.col("uri").cast("string"))
    return uses.join(names, "uri", "left").withColumn("shown", X.short_label(picked)).drop("label_en", "label_nl")


def group_members(jobs: DataFrame, matches: DataFrame, connectors: DataFrame) -> DataFrame:
    """Every posting with the other members of its duplicate group counted, source name and matches.

    Members are aggregated per group, so no pair of members is written.
    """
    sizes = jobs.groupBy("dedup_group_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.struct("source_priority", "job_id")).alias("_top"),
    )
    n_match = matches.groupBy("job_id").agg(F.count(F.lit(1)).alias("matches"))
    return (
        jobs.select("job_id", "dedup_group_id", "source_id")
        .join(sizes, "dedup_group_id").join(n_match, "job_id", "left").join(connectors, "source_id", "left")
        .select(
            "job_id", "dedup_group_id", (F.col("_n") - 1).alias("other_members"),
            F.col("_top.job_id").alias("top_member"), "source_name",
            F.coalesce("matches", F.lit(0)).alias("matches"),
        )
    )


# --- lookup by label ----------------------------------------------------------------------


def trigrams(text: Column) -> Column:
    """Trigram set of a text: each word padded with two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")

    def grams(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def trigram_similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double"))


def rarest_first(rows: DataFrame, key: str, tokens: str, counts: DataFrame) -> DataFrame:
    """(key, size, at, g): the tokens of every row in the order of how many labels have them."""
    each = rows.select(key, F.explode(tokens).alias("g")).join(counts, "g", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("_o")
    return each.groupBy(key).agg(order).select(key, F.size("_o").alias("size"), F.posexplode("_o").alias("at", "_x")).select(
        key, "size", "at", "_x.g", "_x.n"
    )


def autocomplete_pairs(queries: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(q, uri) pairs that can be hits; ``queries`` has _needle and _qt, ``labels`` _lt and _runs.

    More than ``threshold`` of either side's trigrams is shared by a similar pair, so the first shared
    one, in an order of rarity, stands early on both sides; common trigrams join nothing. A text that
    contains the needle contains its rarest run too. The runs of all labels are shuffled, never broadcast.
    """
    counts = labels.select(F.explode("_lt").alias("g")).groupBy("g").agg(F.count("*").alias("n"))

    def first(rows: DataFrame, key: str, tokens: str) -> DataFrame:
        o = rarest_first(rows, key, tokens, counts)
        return o.filter(F.col("at") < F.col("size") - F.floor(F.col("size") * threshold))

    a, b = first(queries, "q", "_qt").filter("n > 0").alias("a"), first(labels, "uri", "_lt").alias("b")
    least = F.floor((F.col("a.size") + F.col("b.size")) * (threshold / (1 + threshold)) - 1e-9) + 1
    rest = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    sized = F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * threshold - 1e-9
    similar = a.join(b.hint("merge"), (F.col("a.g") == F.col("b.g")) & sized & (rest >= least)).select("q", "uri")
    runs = labels.select("uri", F.explode("_runs").alias("g"))
    often = runs.groupBy("g").agg(F.count("*").alias("n"))
    rare = queries.select("q", F.explode("_qruns").alias("g")).join(often, "g").groupBy("q").agg(F.min(F.struct("n", "g"))["g"].alias("g"))
    return similar.unionByName(rare.join(runs.hint("merge"), "g").select("q", "uri")).distinct()


def autocomplete(queries: DataFrame, labels: DataFrame, k: int = 10, threshold: float = 0.3) -> DataFrame:
    """Best concepts per query text by trigram similarity, at least 0.5 for a substring."""

    def runs(c: Column, n: int) -> Column:
        last = F.greatest(F.length(c) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(c, i, F.lit(n)))

    needle = F.lower(F.col("q"))
    q = queries.withColumns({"_needle": needle, "_qt": trigrams(F.col("q"))})
    q = q.withColumn("_qruns", F.when(F.length("_needle") < 3, F.array("_needle")).otherwise(F.array_distinct(runs(F.col("_needle"), 3))))
    text = F.col("search_text")
    lt = labels.withColumns({"_lt": trigrams(text), "_runs": F.array_distinct(F.concat(runs(text, 3), runs(text, 2), runs(text, 1)))})
    both = autocomplete_pairs(q, lt, threshold).join(q.select("q", "_needle", "_qt"), "q").join(lt.drop("_runs").hint("merge"), "uri")
    similar = trigram_similarity(F.col("_qt"), F.col("_lt"))
    inside = F.col("search_text").contains(F.col("_needle"))
    score = F.greatest(F.coalesce(similar, F.lit(0.0)), F.when(inside, 0.5).otherwise(0.0))
    hits = both.filter((similar > threshold) | inside).withColumn("score", score)
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.length("label_en"), "uri")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= min(k, 25)).select(
        "q", "uri", "score", "rank"
    )


def lexical_search(queries: DataFrame, entries: DataFrame, k: int = 10) -> DataFrame:
    """Exact 3, prefix 2, contained 1; best label per concept, ``k`` concepts per query.

    ``entries`` is (uri, norm). A label that contains a query of three characters or more contains its
    rarest run of three, so the join is on that one. Shorter queries are runs themselves and meet the
    labels' runs of one and two characters.
    """

    def keys(c: Column, size: int) -> Column:
        n = F.greatest(F.length(c) - (size - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(c, i, F.lit(size)))

    def runs(*sizes: int) -> DataFrame:
        each = F.array_distinct(F.concat(*[keys(F.col("norm"), n) for n in sizes]))
        return entries.select("uri", "norm", F.explode(each).alias("g"))

    q = queries.withColumn("qn", X.normalize_label(F.col("q"))).filter(F.col("qn") != "").select("q", "qn")
    often = runs(3).groupBy("g").agg(F.count("*").alias("n"))
    whole = q.filter(F.length("qn") > 2).select("q", "qn", F.explode(F.array_distinct(keys(F.col("qn"), 3))).alias("g"))
    probe = whole.join(often, "g").groupBy("q", "qn").agg(F.min(F.struct("n", "g"))["g"].alias("g"))
    short = q.filter(F.length("qn") < 3).withColumn("g", F.col("qn"))
    # a single letter is in most labels, so hot runs are dealt over many tasks
    hits = probe.join(runs(3).hint("merge"), "g").unionByName(salted_join(runs(1, 2), short, "g", "uri"))
    score = (
        F.when(F.col("norm") == F.col("qn"), 3).when(F.col("norm").startswith(F.col("qn")), 2)
        .when(F.col("norm").contains(F.col("qn")), 1)
    )
    best = hits.withColumn("score", score).filter(F.col("score").isNotNull()).groupBy("q", "uri").agg(
        F.max("score").alias("score")
    )
    w = Window.partitionBy("q").orderBy(F.desc("score"), "uri")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
