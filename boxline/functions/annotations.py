"""Model responses and label lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxline.functions.binding import bind
from boxline.schemas import CLASSES, LABEL_JSON

# The flat form `name: [x, y, x, y]` and the object form, as regular expressions.
FLAT_PATTERN = "(?U)[\"']?(\\w+)[\"']?\\s*[:\\s]\\s*\\[(\\d+),\\s*(\\d+),\\s*(\\d+),\\s*(\\d+)\\]"
OBJECT_PATTERN = "(?s)(\\{.*\"objects\".*\\})"
FENCE = "```"


def json_part(response: Column) -> Column:
    """The JSON inside a response; null when the response holds none."""
    tagged = F.split(F.get(F.split(response, FENCE + "json", -1), F.lit(1)), FENCE, -1)[0]
    fenced = F.get(F.split(response, FENCE, -1), F.lit(1))
    loose = F.regexp_extract(response, OBJECT_PATTERN, 1)
    return (
        F.when(F.contains(response, F.lit(FENCE + "json")), F.trim(tagged))
        .when(F.contains(response, F.lit(FENCE)), F.trim(fenced))
        .when(loose != "", loose)
    )


def flat_objects(response: Column, classes: list[str] = CLASSES) -> Column:
    """Boxes of known classes found by pattern: array of struct(class, bbox)."""
    found = F.regexp_extract_all(response, F.lit(FLAT_PATTERN), F.lit(0))

    def parts(match: Column) -> Column:
        # A hit ends in its numbers; casts drop the spaces around them.
        numbers = F.split(F.rtrim(F.substring_index(match, "[", -1), F.lit("]")), ",")
        return F.struct(
            F.regexp_extract(match, "(?U)(\\w+)", 1).alias("class"),
            F.transform(numbers, lambda n: n.try_cast("int")).alias("bbox"),
        )

    boxes = F.transform(found, parts)
    return F.filter(boxes, lambda b: b["class"].isin(classes))


def json_objects(response: Column) -> Column:
    """Boxes of the JSON part; null when it is absent or broken."""
    parsed = F.from_json(json_part(response), LABEL_JSON)["objects"]
    return F.transform(
        parsed, lambda o: F.struct(o["class"].alias("class"), o["bbox"].alias("bbox"))
    )


def is_label_line(line: Column, class_count: int = len(CLASSES)) -> Column:
    """Whether a line reads ``class_id cx cy w h`` with a known class and values in 0..1."""
    def holds(parts: Column) -> Column:
        class_id = F.get(parts, F.lit(0)).try_cast("int")
        good = (F.size(parts) == 5) & (class_id >= 0) & (class_id < class_count)
        for i in range(1, 5):
            value = F.get(parts, F.lit(i)).try_cast("double")
            good = good & (value >= 0) & (value <= 1)
        return good

    parts = F.split(F.regexp_replace(line, "(?U)^\\s+|\\s+$", ""), "(?U)\\s+")
    return F.coalesce(bind(parts, holds), F.lit(False))


def label_line(class_id: Column, cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", class_id, cx, cy, w, h)
