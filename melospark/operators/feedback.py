"""User ratings: upsert, history bound, counts and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_RECORDS = 20
MOST_NOTES, PER_LINE = 120, 16
#: Labels of the issues a user can tick.
ISSUES = {
    "missing-notes": "Notes are missing",
    "extra-notes": "Spurious notes",
    "wrong-pitches": "Wrong pitches",
    "wrong-rhythm": "Wrong rhythm or timing",
    "wrong-key": "Wrong key or spelling",
    "unreadable": "Score is unreadable",
}


def recency(columns: list[str]) -> Column:
    """What ratings are ordered by: at_seq, then their other fields by name, so that equal at_seq are ordered too."""
    return F.struct("at_seq", *sorted(c for c in columns if c not in ("at_seq", "user_id")))


def latest_ratings(submissions: DataFrame) -> DataFrame:
    """The last submission of each user and take (by at_seq; of equal ones that whose fields sort last)."""
    newest = Window.partitionBy("user_id", "take_id").orderBy(F.desc(recency(submissions.columns)))
    return submissions.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")


def recent_feedback(ratings: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """The newest ``most`` ratings of each user."""
    newest = Window.partitionBy("user_id").orderBy(F.desc(recency(ratings.columns)))
    return ratings.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= most).drop("nth")


def feedback_upsert(submissions: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """Re-rating a take replaces its rating; each user keeps the newest ``most``. Two ranks: the first, by user
    and take, spreads hot users; the second sees one row per take."""
    return recent_feedback(latest_ratings(submissions), most)


def merge_feedback(history: DataFrame, new: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """Adds new ratings to a stored history."""
    new = new.select(*history.columns)
    kept = history.join(new.select("user_id", "take_id").distinct(), ["user_id", "take_id"], "left_anti")
    return recent_feedback(kept.unionByName(latest_ratings(new)), most)


def feedback_counts(ratings: DataFrame) -> DataFrame:
    """user_id, good, bad."""
    return ratings.groupBy("user_id").agg(F.count_if(F.col("verdict") == "good").alias("good"), F.count_if(F.col("verdict") == "bad").alias("bad"))


def issue_label(issue: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ISSUES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, issue), issue)


def issue_labels(issues: Column) -> Column:
    """Labels in order, joined by "; "; unknown ids stay as they are."""
    return F.array_join(F.transform(issues, issue_label), "; ")


def wrap_notes(notes: Column, most: int = MOST_NOTES, per_line: int = PER_LINE) -> Column:
    """Lines of names, at most ``most`` names, then how many more; "(none)" for none."""
    kept = F.slice(notes, 1, most)
    starts = F.sequence(F.lit(0), F.floor((F.size(kept) - 1) / per_line).cast("int"))
    lines = F.transform(starts, lambda k: F.array_join(F.slice(kept, k * per_line + 1, F.lit(per_line)), " "))
    more = F.array(F.concat(F.lit("... and "), (F.size(notes) - most).cast("string"), F.lit(" more")))
    all_ = F.when(F.size(notes) > most, F.concat(lines, more)).otherwise(lines)
    return F.when(F.size(notes) == 0, F.array(F.lit("(none)"))).otherwise(all_)


def record_block(number: Column, funnel_text: Column | None = None) -> Column:
    """Text of one rating. Lines that don't apply are null and left out."""

    def indented(lines: Column) -> Column:
        return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  "), x)), "\n")

    issues = F.coalesce(F.nullif(issue_labels(F.col("issues")), F.lit("")), F.lit("(not specified)"))
    funnel = F.lit("funnel     (not captured)")
    if funnel_text is not None:
        funnel = F.coalesce(F.concat(F.lit("funnel\n"), indented(F.split(funnel_text, "\n"))), funnel)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("--- take "), number.cast("string"), F.lit(": "), F.upper("verdict"), F.lit(" ---")),
        F.concat(F.lit("when       "), F.col("at_seq").cast("string")),
        F.concat(F.lit("source     "), F.col("source"), F.lit(", "), F.format_string("%.1f", "duration_s"), F.lit("s")),
        F.concat(F.lit("settings   voice="), F.col("voice_range"), F.lit(" transpose="), F.col("transpose").cast("string")),
        F.concat(F.lit("result     "), F.col("key_label"), F.lit(", "), F.col("bpm").cast("string"), F.lit(" bpm, "), F.size("notes").cast("string"), F.lit(" notes")),
        F.when(F.col("verdict") == "bad", F.concat(F.lit("problem    "), issues)),
        F.when(F.col("comment") != "", F.concat(F.lit("comment    "), F.col("comment"))),
        funnel,
        F.concat(F.lit("notes\n"), indented(wrap_notes(F.col("notes")))),
        F.when(F.size("rhythm") > 0, F.concat(F.lit("rhythm  (grid steps, start:duration)\n"), indented(wrap_notes(F.col("rhythm"))))),
        F.lit(""),
    )


def feedback_report(ratings: DataFrame, funnel_text: Column | None = None, title: str = "FEEDBACK") -> DataFrame:
    """user_id, report: a header with counts, then a block per rating in order of at_seq."""
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("at_seq"))
    blocks = ratings.withColumn("nth", number)
    blocks = blocks.select("user_id", "verdict", "nth", record_block(F.col("nth"), funnel_text).alias("block"))
    grouped = blocks.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("verdict") == "good").alias("good"),
        F.count_if(F.col("verdict") == "bad").alias("bad"),
        F.array_sort(F.collect_list(F.struct("nth", "block"))).alias("held"),
    )
    header = F.format_string("%s\ntakes: %d  (%d good, %d bad)\n", F.lit(title), "n", "good", "bad")
    return grouped.select("user_id", F.concat_ws("\n", header, F.array_join(F.col("held.block"), "\n")).alias("report"))
