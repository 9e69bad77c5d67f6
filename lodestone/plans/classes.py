"""Class state: totals, calibration, grading summaries, queues, exports and question assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.operators.joins import anti, latest, left_where, with_constant
from lodestone.operators.ordering import numbered

DOSSIER = ["user_id", "offering_id", "deliverable_id"]


def student_totals(enrollments: DataFrame, users: DataFrame, dossiers: DataFrame, deliverables: DataFrame) -> DataFrame:
    """Points by part for each student who has not dropped; a final dossier counts if it is the latest (ties by dossier id)."""
    final = dossiers.where(F.col("is_final").cast("boolean"))
    last = latest(final, DOSSIER, "graded_at").groupBy(*DOSSIER).agg(F.max_by(F.struct("points_awarded", "graded_at"), "dossier_id").alias("x")).select(*DOSSIER, "x.*")
    known = deliverables.select("offering_id", "deliverable_id", F.col("track").alias("d_track"), F.lit(True).alias("known"))
    e = enrollments.where((F.col("role") == "student") & (F.col("status") != "dropped")).join(users, "user_id")
    rows = e.join(last, ["user_id", "offering_id"], "left").join(known, ["offering_id", "deliverable_id"], "left")
    # A deliverable's own parts count only where the deliverable is listed.
    listed = F.coalesce("known", F.lit(False))
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("points_awarded"))), F.lit(0.0))
    return rows.groupBy("offering_id", "user_id").agg(
        F.any_value(F.concat("first_name", F.lit(" "), "last_name")).alias("name"), F.any_value("email").alias("email"), F.any_value("track").alias("track"), F.any_value("f160_track").alias("f160_track"),
        *(part(listed & (F.col("deliverable_id") == d)).alias(f"{d.lower()}_pts") for d in ("A0", "A1")), part(F.col("d_track") == F.col("track")).alias("track_pts"), part(listed & (F.col("deliverable_id") == "F160")).alias("f160_pts"),
        F.coalesce(F.sum("points_awarded"), F.lit(0.0)).alias("total_pts"), F.max("graded_at").alias("last_graded_at"),
    )


def calibration(runs: DataFrame, deliverables: DataFrame) -> DataFrame:
    """The latest calibration runs of each deliverable; runs tied on the time all stay."""
    return latest(runs, ["offering_id", "deliverable_id"], "run_at").join(deliverables, ["offering_id", "deliverable_id"])


def grading_counts(submissions: DataFrame, dossiers: DataFrame, appeals: DataFrame, offering: str) -> DataFrame:
    """One row: submissions, final dossiers and open appeals of an offering."""
    of = lambda d: d.where(F.col("offering_id") == offering)
    n = of(submissions).agg(F.count("*").alias("n_submissions"))
    return n.crossJoin(F.broadcast(of(dossiers).agg(F.count_if(F.col("is_final").cast("boolean")).alias("n_final")))).crossJoin(F.broadcast(of(appeals).agg(F.count_if(F.col("status") == "open").alias("n_open_appeals"))))


def grading_queue(enrollments: DataFrame, deliverables: DataFrame, dossiers: DataFrame) -> DataFrame:
    """Student and deliverable pairs that are due: common ones and those of the student's track, without a dossier."""
    students = enrollments.where((F.col("role") == "student") & (F.col("status") != "dropped")).select("offering_id", "user_id", F.col("track").alias("s_track"))
    pairs = students.join(deliverables, "offering_id").where(F.col("track").isNull() | (F.col("track") == F.col("s_track")))
    return anti(pairs.select("offering_id", "user_id", "deliverable_id"), dossiers.select(*DOSSIER).distinct(), DOSSIER)


def latest_files(files: DataFrame) -> DataFrame:
    """The path of the greatest name for each student and deliverable."""
    return files.groupBy("user_id", "deliverable_id").agg(F.max_by("path", "name").alias("path"))


def grades(totals: DataFrame, cutoffs: list[tuple[float, str]], most: float = 100.0) -> DataFrame:
    score = rules.clamped(F.col("total_pts"), most)
    return totals.select("user_id", "name", score.alias("score"), rules.letter_grade(score, cutoffs).alias("letter"))


def one_final(dossiers: DataFrame) -> DataFrame:
    """Keys with more than one final dossier: the rows that break the rule."""
    return dossiers.where(F.col("is_final").cast("boolean")).groupBy(*DOSSIER).agg(F.count("*").alias("n")).where("n > 1")


def current_round(questions: DataFrame, claims: DataFrame, rounds: int = 99) -> DataFrame:
    """One row: the first round (1 to ``rounds``) in which not every question has been claimed; 1 if there is none."""
    used = claims.groupBy("round").agg(F.count_distinct("question_id").alias("n"))
    total = questions.agg(F.count_distinct("question_id").alias("total"))
    whole = used.crossJoin(F.broadcast(total)).where("n >= total").select(F.col("round").cast("long").alias("round"), F.lit(True).alias("whole"))
    numbers = claims.sparkSession.range(1, rounds + 1).withColumnRenamed("id", "round")
    return numbers.join(whole, "round", "left").where("whole is null").agg(F.coalesce(F.min("round"), F.lit(1)).alias("round"))


def question_need(questions: DataFrame, claims: DataFrame) -> DataFrame:
    """Questions by need: claimants and articles over claims that are not released, least served first."""
    c = claims.withColumnRenamed("question_id", "c_question")
    rows = left_where(questions, c, questions.question_id == F.col("c_question"), F.col("released_at").isNull())
    total = lambda *cs: F.coalesce(F.sum(sum((F.col(x) for x in cs), F.lit(0))), F.lit(0))
    out = rows.groupBy("question_id").agg(F.count_distinct("user_id").alias("times_claimed"), total("task1_count").alias("total_experimental"), total("task2_count").alias("total_any_type"), total("task1_count", "task2_count").alias("total_articles"))
    return out.withColumn("need_level", rules.need_level(F.col("total_articles"))).orderBy("total_articles", "times_claimed", "question_id")


def available(questions: DataFrame, claims: DataFrame, round_: int) -> DataFrame:
    return anti(questions.select("question_id"), claims.where(F.col("round") == round_).select("question_id"), ["question_id"])


def assigned(questions: DataFrame, claims: DataFrame) -> DataFrame:
    """One row (question_id, round): the least served question that is free in the current round, else in the next, else of all."""
    r = current_round(questions, claims)
    need = question_need(questions, claims)
    options = need.crossJoin(F.broadcast(r)).select("question_id", "total_articles", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.col("round").alias("round")), F.struct(F.lit(1).alias("tier"), (F.col("round") + 1).alias("round")))).alias("x")).select("question_id", "total_articles", "x.tier", "x.round")
    free = options.join(claims.select("question_id", F.col("round").cast("long")).distinct(), ["question_id", "round"], "left_anti")
    rest = options.where("tier = 1").withColumn("tier", F.lit(2))
    return free.unionByName(rest).orderBy("tier", "total_articles", "question_id").limit(1).select("question_id", "round")


def assigned_all(questions: DataFrame, claims: DataFrame, users: DataFrame, order: str, rounds: int = 99) -> DataFrame:
    """(user_id, question_id, round): a question for every user, as if each in turn (by ``order``) were given one by ``assigned``.

    A round's free questions go out by need before the next round opens. So the
    n-th user gets the n-th free place, in the order of rounds and needs: places
    are counted by round, only the rounds that are needed are laid out, and
    places and users meet by their numbers. Users beyond the last round get the
    least served question in round 2, as ``assigned`` says. Without questions
    nobody gets one.
    """
    need = question_need(questions, claims).select("question_id", "total_articles").dropDuplicates(["question_id"])
    taken = claims.select("question_id", F.col("round").cast("long").alias("round")).join(need.select("question_id"), "question_id", "left_semi").distinct()
    asked = numbered(users.select("user_id", order), "n", F.col(order), F.col("user_id"))
    sizes = with_constant(need.agg(F.count("*").alias("questions")), asked.agg(F.count("*").alias("users")))
    # A row a round, so one window over them is small.
    used = claims.sparkSession.range(1, rounds + 1).withColumnRenamed("id", "round").join(taken.groupBy("round").agg(F.count("*").alias("used")), "round", "left")
    room = with_constant(used, sizes).withColumn("room", F.col("questions") - F.coalesce("used", F.lit(0)))
    before = F.sum("room").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1))
    open_ = room.withColumn("before", F.coalesce(before, F.lit(0))).where("before < users AND room > 0").agg(F.collect_list("round").alias("rounds"))
    places = with_constant(need, open_).select("question_id", "total_articles", F.explode("rounds").alias("round")).join(taken, ["question_id", "round"], "left_anti")
    places = numbered(places, "n", F.col("round"), F.col("total_articles"), F.col("question_id")).select("n", "question_id", "round")
    least = need.agg(F.min(F.struct("total_articles", "question_id")).alias("least")).where("least is not null")
    out = with_constant(asked.join(places, "n", "left"), least)
    return out.select("user_id", F.coalesce("question_id", "least.question_id").alias("question_id"), F.coalesce("round", F.lit(2).cast("long")).alias("round"))


def repairable(questions: DataFrame, claims: DataFrame, user: str, round_: int, current: str = "") -> DataFrame:
    """Free questions of a round, and the user's own released or current ones."""
    own = claims.where((F.col("user_id") == user) & (F.col("round") == round_) & (F.col("released_at").isNotNull() | (F.col("question_id") == current))).select("question_id")
    return available(questions, claims, round_).union(own).distinct().orderBy("question_id")
