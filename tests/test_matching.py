import re

import pytest
from pyspark.sql import functions as F

from gaugeworks import constants as C
from gaugeworks.operators import matching
from gaugeworks.operators.skew import attach, hot_keys
from gaugeworks.sources import keyword_store

TEXTS = {
    "resume": {1: "Python SQL and Excel. Power BI", 2: "nothing in common", 3: ""},
    "jd": {10: "SQL python tableau sql excel.", 20: "the and of", 30: " ".join(f"{a}{b}x" for a in "abcdefg" for b in "abcdefg")},
}


def brute(resume, jd):
    def words(text):
        return [w for w in re.findall(r"[A-Za-z][A-Za-z+#.]+", text.lower()) if w not in C.STOP_WORDS and len(w) > 2]

    have, want = set(words(resume)), words(jd)
    order = sorted(set(want), key=lambda w: (-want.count(w), want.index(w)))[:35]
    matched = [w for w in order if w in have]
    return round(len(matched) / max(len(order), 1) * 100), matched, [w for w in order if w not in have]


@pytest.fixture
def tables(spark):
    resumes = spark.createDataFrame(list(TEXTS["resume"].items()), "resume_id bigint, text string")
    jds = spark.createDataFrame(list(TEXTS["jd"].items()), "jd_id bigint, text string")
    pairs = resumes.select("resume_id").crossJoin(jds.select("jd_id"))
    return pairs.union(pairs), resumes, jds


def test_match_against_brute_force(tables):
    pairs, resumes, jds = tables
    got = {(r.resume_id, r.jd_id): (r.score, r.matched, r.missing) for r in matching.match_pairs(*tables).collect()}
    want = {(r, j): brute(rt, jt) for r, rt in TEXTS["resume"].items() for j, jt in TEXTS["jd"].items()}
    assert got == want and got[(1, 10)][0] == 75 and len(got[(1, 30)][2]) == 35
    assert matching.match_pairs(*tables).count() == 9
    blank_free = matching.match_pairs(pairs, matching.non_blank(resumes), jds)
    assert blank_free.count() == 6


def test_coverage_adds_up(tables):
    counts = {(r.resume_id, r.jd_id, r.category): r["count"] for r in matching.keyword_coverage(matching.match_pairs(*tables)).collect()}
    assert counts[(1, 10, "Matched")] == 3 and counts[(1, 10, "Missing")] == 1 and len(counts) == 18


def test_whole_texts_unless_asked(spark):
    frame = spark.createDataFrame([("alpha " * 3000 + "omega",)], "text string")
    assert matching.non_blank(frame).first().text.endswith("omega")
    assert matching.non_blank(frame, max_chars=12_000).first().text.endswith(C.TRUNCATION_MARK)


def test_keywords_need_no_shuffle(spark, tables):
    _, resumes, jds = tables
    for frame in (matching.keyword_counts(resumes, "resume_id"), matching.ranked_keywords(jds, "jd_id")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Filter (size" not in plan


def test_feedback_and_reports(spark, tables):
    matches = matching.match_pairs(*tables).where("resume_id = 1 AND jd_id = 10")
    plain = matching.candidate_feedback(matches).first()
    assert plain.strengths == ["sql", "python", "excel."] and plain.gaps == ["tableau"]
    reply = spark.createDataFrame([(1, 10, '{"strengths": ["x"]}')], "resume_id bigint, jd_id bigint, reply string")
    given = matching.candidate_feedback(matching.match_pairs(*tables, replies=reply).where("resume_id = 1 AND jd_id = 10"))
    assert given.first().strengths == ["x"] and given.first().gaps == ["tableau"]
    assert "- x" in matching.feedback_report(given).first().report
    assert "sql, python, excel." in matching.candidate_report(matches).first().report


def test_prompts_are_redacted(spark, tables):
    pairs, resumes, jds = tables
    secret = resumes.withColumn("text", F.concat("text", F.lit(" me@example.org")))
    prompts = matching.candidate_prompts(matching.match_pairs(pairs, secret, jds, with_texts=True))
    assert prompts.where("prompt LIKE '%example.org%'").isEmpty()
    assert prompts.where("prompt LIKE '%[REDACTED_EMAIL]%'").count() == 9


def test_hot_keys(spark):
    frame = spark.range(9000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id") + 100).alias("k"))
    assert [tuple(r) for r in hot_keys(frame, "k", 90).collect()] == [(7, 34)]


def test_a_key_with_a_tiny_share_is_split(spark):
    """The bound is a number of rows, whatever share of the table they are: 0.05 % here."""
    frame = spark.range(200_000).select(F.when(F.col("id") < 100, -1).otherwise(F.col("id")).alias("k"), "id")
    hot = hot_keys(frame, "k", 50)
    assert [tuple(r) for r in hot.collect()] == [(-1, 2)]
    right = spark.createDataFrame([(-1, "x"), (500, "y")], "k long, v string")
    assert attach(frame, right, "k", ["id"], hot, "inner").count() == 101


def test_attach_spreads_a_hot_key(spark):
    """A third of the rows on one key and a third without a key: same result as a plain join, in even parts."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id"))
    left = spark.range(30_000).select(key.alias("k"), F.col("id").alias("row"))
    right = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).where("k % 2 = 1")
    for how in ("left", "inner"):
        got = attach(left, right, "k", ["row"], hot_keys(left, "k", 100), how)
        want = left.join(right, "k", how)
        assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == want.count()


def test_attach_parts_are_even(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        left = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
        right = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))

        def largest(frame):
            return frame.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]

        assert largest(left.join(right, "k")) > 20_000
        assert largest(attach(left, right, "k", ["row"], hot_keys(left, "k", 500), "inner")) < 13_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_attach_without_rows_or_keys(spark):
    right = spark.createDataFrame([("a", 1)], "k string, v int")
    for rows in ([], [(None, 1), (None, 2)]):
        left = spark.createDataFrame(rows, "k string, row int")
        assert attach(left, right, "k", ["row"], hot_keys(left, "k")).count() == len(rows)


def scans(frame, column):
    """How many scans of a physical plan read a column."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return sum(f" {column}#" in line.split("PartitionFilters")[0] or f",{column}#" in line or f"[{column}#" in line for line in plan.splitlines() if "FileScan" in line)


def test_texts_are_read_once(spark):
    import registered

    folder = "/root/testdata/sf0.001"
    # Once for the resumes and once for the jobs.
    assert scans(registered.QUERIES["candidate_prompts"](spark, folder), "text") == 2
    assert scans(registered.QUERIES["validated_feedback"](spark, folder), "text") == 2
    # Once for the scored side, once for the view that invents the replies.
    assert scans(registered.QUERIES["merged_triage"](spark, folder), "o_orderkey") == 2
    assert "RoundRobin" not in registered.QUERIES["ticket_triage"](spark, folder)._jdf.queryExecution().executedPlan().toString()


def above_scans(frame, table):
    """What the rows of a stored table meet first on their way up: a join or an exchange, for each of its scans."""
    met = []

    def walk(node, path):
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), [node.nodeName(), *path])
        if children.size() == 0 and table in node.toString() and "Scan" in node.nodeName():
            met.append(next(n for n in path if "Join" in n or "Exchange" in n))

    walk(frame._jdf.queryExecution().executedPlan(), [])
    return met


@pytest.mark.parametrize("rows_per_part", [1_000_000, 3])
def test_stored_keywords_stay_where_they_are(spark, tmp_path, rows_per_part):
    texts = ["spark sql python data", "java spring sql", "", None, "python pandas spark sql sql", "go rust"]
    resumes = spark.createDataFrame(list(enumerate(texts * 5)), "resume_id long, text string")
    jds = spark.createDataFrame([(0, "spark spark sql engineer"), (1, "rust and go"), (2, " ")], "jd_id long, text string")
    pairs = spark.createDataFrame(
        [(i, j) for i in range(30) for j in (0, 0, i % 4)] + [(4, j) for j in range(9)] + [(None, 0), (1, None)], "resume_id long, jd_id long")
    resumes, jds = matching.non_blank(resumes), matching.non_blank(jds)
    name = f"kept_{rows_per_part}"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = keyword_store.store(matching.job_keywords(jds), f"{name}_jobs", f"{tmp_path}/jobs", "jd_id")
        offered = keyword_store.store(matching.resume_keywords(resumes), f"{name}_resumes", f"{tmp_path}/resumes", "resume_id")
        got = matching.match_stored(pairs, wanted, offered, rows_per_part)
        for side in ("jobs", "resumes"):
            met = above_scans(got, f"{name}_{side}")
            assert met and set(met) == {"SortMergeJoin"}, (side, met)
        want = sorted(map(str, matching.match_pairs(pairs, resumes, jds).collect()))
        assert sorted(map(str, got.collect())) == want and len(want) > 20
        # A session that does not know the table declares it again.
        spark.sql(f"DROP TABLE {name}_resumes")
        again = keyword_store.open_table(spark, f"{name}_again", f"{tmp_path}/resumes", "resume_id", "resume_id BIGINT, offered ARRAY<STRING>", 4)
        later = matching.match_stored(pairs, wanted, again, rows_per_part)
        assert set(above_scans(later, f"{name}_again")) == {"SortMergeJoin"} and sorted(map(str, later.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        for table in (f"{name}_jobs", f"{name}_resumes", f"{name}_again"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
