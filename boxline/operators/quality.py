"""Label quality: distributions, issues, review flags, reports, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxline.functions import geometry as G
from boxline.functions.text import percent
from boxline.operators.hot import HOT_ROWS
from boxline.operators.ordered import OrderedGroups
from boxline.schemas import REQUIRED_CLASSES, UNIQUE_CLASSES, class_number

NO_ISSUE = "labels look normal"
MAX_LABELS = 20


def box_issues(labels: DataFrame, wide: Column, high: Column) -> DataFrame:
    """Labels with an array of the issue codes of their own box."""
    found = F.array_compact(F.array(G.size_issue(wide, high), G.bounds_issue(wide, high)))
    return labels.withColumn("issues", found)


def class_distribution(labels: DataFrame) -> DataFrame:
    """Labels per image and class."""
    return labels.groupBy("image_id", "class").agg(F.count(F.lit(1)).alias("n"))


def duplicate_unique(labels: DataFrame) -> DataFrame:
    """Classes that may occur once but occur more often in an image."""
    return (
        class_distribution(labels.where(F.col("class").isin(UNIQUE_CLASSES)))
        .where(F.col("n") > 1)
        .withColumn("severity", F.lit("high"))
    )


def _class_counts() -> list[Column]:
    wanted = list(dict.fromkeys(REQUIRED_CLASSES + UNIQUE_CLASSES))
    return [F.count_if(F.col("class") == c).alias(f"n_{c}") for c in wanted]


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def missing_required(images: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per image and required class that the image lacks, unlabelled images included."""
    present = labels.where(F.col("class").isin(REQUIRED_CLASSES)).groupBy("image_id").agg(
        *[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in REQUIRED_CLASSES]
    )
    lacking = F.array_compact(F.array(
        *[F.when(_zero(f"n_{c}") == 0, F.lit(c)) for c in REQUIRED_CLASSES]
    ))
    return (
        images.select("image_id").join(present, "image_id", "left")
        .select("image_id", F.explode(lacking).alias("class"))
        .withColumn("severity", F.lit("medium"))
    )


def area_stats(labels: DataFrame) -> DataFrame:
    """Area statistics per image (population deviation)."""
    return labels.groupBy("image_id").agg(*_area_columns())


def _area_columns() -> list[Column]:
    size = G.area()
    return [
        F.avg(size).alias("avg_area"),
        F.min(size).alias("min_area"),
        F.max(size).alias("max_area"),
        F.stddev_pop(size).alias("area_std"),
    ]


def needs_review(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Review flag and reason per image; images without labels are kept and flagged."""
    issue = G.review_size_issue()
    per_image = labels.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.count_if(issue == "invalid_size").alias("n_invalid"),
        F.count_if(issue == "too_small").alias("n_small"),
        *_class_counts(),
    )
    joined = images.select("image_id").join(per_image, "image_id", "left")
    missing = F.array_compact(F.array(
        *[F.when(_zero(f"n_{c}") == 0, F.lit(c)) for c in REQUIRED_CLASSES]
    ))
    repeated = F.array_compact(F.array(
        *[F.when(_zero(f"n_{c}") > 1, F.lit(c)) for c in UNIQUE_CLASSES]
    ))
    sizes = F.array_compact(F.array(
        F.when(_zero("n_invalid") > 0, F.concat(F.col("n_invalid"), F.lit(" invalid_size"))),
        F.when(_zero("n_small") > 0, F.concat(F.col("n_small"), F.lit(" too_small"))),
    ))
    reasons = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        F.when(F.size(repeated) > 0, F.concat(F.lit("repeated: "), F.array_join(repeated, ", "))),
        F.when(F.size(sizes) > 0, F.concat(F.lit("size: "), F.array_join(sizes, ", "))),
        F.when(_zero("n_labels") == 0, "no elements").when(
            F.col("n_labels") > MAX_LABELS, "too many elements"
        ),
    ))
    return joined.select(
        "image_id",
        _zero("n_labels").alias("n_labels"),
        (F.size(reasons) > 0).alias("needs_review"),
        F.when(F.size(reasons) > 0, F.array_join(reasons, "; "))
        .otherwise(F.lit(NO_ISSUE)).alias("reason"),
    )


def recommendations(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Issue counts per image and the advice that follows from them, from one grouping."""
    counts = labels.groupBy("image_id").agg(*_class_counts())
    high = sum((F.coalesce(F.col(f"n_{c}") > 1, F.lit(False)).cast("long") for c in UNIQUE_CLASSES), F.lit(0))
    medium = sum(((_zero(f"n_{c}") == 0).cast("long") for c in REQUIRED_CLASSES), F.lit(0))
    joined = images.select("image_id").join(counts, "image_id", "left").select(
        "image_id", high.alias("n_high"), medium.alias("n_medium")
    )
    return joined.select(
        "image_id",
        (F.col("n_high") + F.col("n_medium")).alias("n_issues"),
        F.when(F.col("n_high") > 0, "check; correct")
        .when(F.col("n_medium") > 0, "check")
        .otherwise("confirm").alias("advice"),
    )


def validation_report(
    images: DataFrame, labels: DataFrame, wide: Column, high: Column
) -> DataFrame:
    """One nested report per image: info, class map, issues, statistics, recommendations.

    Arrays hold one entry per class at most, so they stay small for crowded images.
    """
    classes = class_distribution(labels).groupBy("image_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n"))))
        .alias("class_distribution"),
        F.sum("n").alias("total_labels"),
    )
    def issue(kind: str, name: str, n: Column, severity: str) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), F.lit(name).alias("class"), n.cast("long").alias("n"),
            F.lit(severity).alias("severity"),
        )

    def times(name: str) -> Column:
        return F.coalesce(F.try_element_at("class_distribution", F.lit(name)), F.lit(0))

    # The class counts of an image tell its issues.
    found = F.array_sort(F.array_compact(F.array(
        *[F.when(times(c) > 1, issue("duplicate_unique_element", c, times(c), "high"))
          for c in UNIQUE_CLASSES],
        *[F.when(times(c) == 0, issue("missing_required_element", c, F.lit(None), "medium"))
          for c in REQUIRED_CLASSES],
    )))
    stats = labels.groupBy("image_id").agg(F.struct(*_area_columns()).alias("statistics"))
    no_issue = F.size(F.coalesce("potential_issues", F.array())) == 0
    severe = F.exists("potential_issues", lambda i: i["severity"] == "high")
    advice = F.when(no_issue, F.array(F.lit("confirm"))).otherwise(
        F.when(severe, F.array(F.lit("check"), F.lit("correct"))).otherwise(
            F.array(F.lit("check"))
        )
    )
    return (
        images.select("image_id")
        .join(classes, "image_id", "left")
        .join(stats, "image_id", "left")
        .withColumn("potential_issues", F.when(F.size(found) > 0, found))
        .select(
            F.struct(
                F.col("image_id"),
                F.format_string("%dx%d", wide, high).alias("size"),
                _zero("total_labels").alias("total_labels"),
            ).alias("image_info"),
            "class_distribution", "potential_issues", "statistics",
            advice.alias("recommendations"),
        )
    )


def batch_summary(reviewed: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Totals over reviewed images and images that could not be read."""
    good = reviewed.agg(
        F.count(F.lit(1)).alias("successful"),
        F.count_if(F.col("needs_review")).alias("needs_review"),
    )
    bad = F.lit(0).cast("long")
    if failed is not None:
        good = good.join(
            F.broadcast(failed.agg(F.count(F.lit(1)).alias("_failed"))), F.lit(True)
        )
        bad = F.col("_failed")
    return good.select(
        (F.col("successful") + bad).alias("total_processed"),
        "successful", bad.alias("failed"), "needs_review",
    )


def label_diff(original: DataFrame, corrected: DataFrame) -> DataFrame:
    """Per image and distinct (class, box): how many labels were kept, added and removed.

    Both label lists are counted in one grouping, so no join meets a crowded image.
    """
    fields = ["image_id", "class", *G.BOX]
    both = original.select(*fields, F.lit(1).alias("o"), F.lit(0).alias("c")).unionByName(
        corrected.select(*fields, F.lit(0).alias("o"), F.lit(1).alias("c"))
    )
    counted = both.groupBy(*fields).agg(F.sum("o").alias("o"), F.sum("c").alias("c"))
    return counted.select(
        *fields,
        F.least("o", "c").alias("kept"),
        F.greatest(F.col("c") - F.col("o"), F.lit(0)).alias("added"),
        F.greatest(F.col("o") - F.col("c"), F.lit(0)).alias("removed"),
    )


def corrections(diff: DataFrame) -> DataFrame:
    """Per image: whether it was corrected, and the classes that only the new labels have."""
    per_class = diff.groupBy("image_id", "class").agg(
        F.sum(F.col("kept") + F.col("removed")).alias("before"),
        F.sum(F.col("kept") + F.col("added")).alias("after"),
        F.sum(F.col("added") + F.col("removed")).alias("changed"),
    )
    fresh = (F.col("before") == 0) & (F.col("after") > 0)
    return per_class.groupBy("image_id").agg(
        (F.sum("changed") > 0).alias("corrected"),
        F.array_sort(F.collect_set(F.when(fresh, F.col("class")))).alias("corrected_classes"),
    )


def session_statistics(diff: DataFrame) -> DataFrame:
    """Totals and percentages over all validated images."""
    return corrections(diff).agg(
        F.count(F.lit(1)).alias("total_validated"),
        F.count_if(F.col("corrected")).alias("total_corrected"),
    ).select(
        "total_validated",
        "total_corrected",
        percent(1 - F.try_divide("total_corrected", "total_validated")).alias("overall_accuracy"),
        percent(F.try_divide("total_corrected", "total_validated")).alias("correction_rate"),
    )


def class_accuracy(diff: DataFrame) -> DataFrame:
    """Per class: original labels, those that were removed or changed, and the accuracy."""
    return diff.groupBy("class").agg(
        F.sum(F.col("kept") + F.col("removed")).alias("total"),
        F.sum("removed").alias("errors"),
    ).select(
        "class", "total", "errors",
        percent(F.try_divide(F.col("total") - F.col("errors"), F.col("total"))).alias("accuracy"),
    )


def spec_violations(
    labels: DataFrame, wide: Column, high: Column, limit: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Labels that break the labelling rules: inside the image, same class from top to bottom.

    ``seq`` gives the order in which an image's labels were written.
    """
    groups = OrderedGroups(labels, ["image_id", "class"], ["seq"], limit=limit, hot=hot)
    rows = groups.previous({"above": F.col("y1")}).frame()
    return rows.select(
        *[c for c in rows.columns if c != "above"],
        G.bounds_issue(wide, high).isNotNull().alias("outside"),
        F.coalesce(F.col("y1") < F.col("above"), F.lit(False)).alias("out_of_order"),
        class_number(F.col("class")).isNull().alias("unknown_class"),
    ).where("outside OR out_of_order OR unknown_class")
