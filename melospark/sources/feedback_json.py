"""Rating histories stored as JSON text, read tolerantly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIELDS = {"takeId": "STRING", "comment": "STRING", "notes": "ARRAY", "rhythm": "ARRAY", "issues": "ARRAY"}


def read_feedback_json(stored: DataFrame, key_col: str = "user_id", json_col: str = "raw", most: int = 20) -> DataFrame:
    """Valid records of each stored history, the last ``most`` by position: key, pos, verdict, take_id, comment,
    issues, notes, rhythm (arrays of strings).

    Text that isn't JSON, or no array, gives no rows; invalid members are left out. A record is valid when its
    verdict is good or bad, takeId and comment are strings, and notes, rhythm and issues are arrays.
    """
    parsed = stored.select(F.col(key_col), F.try_parse_json(json_col).alias("v"))
    arrays = parsed.where(F.schema_of_variant("v").startswith("ARRAY"))
    members = arrays.lateralJoin(stored.sparkSession.tvf.variant_explode(F.col("v").outer())).select(key_col, "pos", "value")

    def kind(path: str):
        return F.schema_of_variant(F.try_variant_get("value", f"$.{path}", "variant"))

    valid = F.try_variant_get("value", "$.verdict", "string").isin("good", "bad") & (kind("verdict") == "STRING")
    for name, wanted in FIELDS.items():
        valid = valid & kind(name).startswith(wanted)
    last = Window.partitionBy(key_col).orderBy(F.desc("pos"))
    kept = members.where(F.schema_of_variant("value").startswith("OBJECT")).where(valid).withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= most)
    lists = {n: F.try_variant_get("value", f"$.{n}", "array<string>").alias(n) for n in ("issues", "notes", "rhythm")}
    return kept.select(
        key_col,
        F.col("pos").cast("long").alias("pos"),
        F.try_variant_get("value", "$.verdict", "string").alias("verdict"),
        F.try_variant_get("value", "$.takeId", "string").alias("take_id"),
        F.try_variant_get("value", "$.comment", "string").alias("comment"),
        *lists.values(),
    )


def feedback_json(ratings: DataFrame, key_col: str = "user_id", fields: tuple[str, ...] = ("verdict", "take_id", "at_seq")) -> DataFrame:
    """One JSON array per user, in order of at_seq: key, raw."""
    held = F.array_sort(F.collect_list(F.struct(F.col("at_seq").alias("__at"), F.struct(*fields).alias("r"))))
    return ratings.groupBy(key_col).agg(F.to_json(F.transform(held, lambda s: s["r"])).alias("raw"))


def write_feedback_json(ratings: DataFrame, path: str, key_col: str = "user_id") -> None:
    feedback_json(ratings, key_col).write.mode("overwrite").parquet(path)


def clear_feedback_json(users: DataFrame, path: str, key_col: str = "user_id") -> None:
    """Empty histories for all users."""
    users.select(key_col).distinct().withColumn("raw", F.lit("[]")).write.mode("overwrite").parquet(path)
