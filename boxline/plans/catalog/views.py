"""The derived tables of ``boxline.fixtures`` as SQL common table expressions."""

DETECTIONS = """detections AS (
  SELECT l_orderkey AS image_id,
    l_partkey * 1000000 + l_suppkey % 1000 * 1000 + l_linenumber * 100
      + CAST(l_quantity AS INT) AS det_id,
    l_linenumber - 1 AS class_id,
    ['receiver_avatar', 'receiver_name', 'input_box', 'send_button', 'chat_message',
     'contact_item', 'user_avatar'][l_linenumber] AS class,
    CAST((l_partkey * 37) % 780 - 10 AS INT) AS x1,
    CAST((l_suppkey * 53) % 580 - 10 AS INT) AS y1,
    CAST((l_partkey * 37) % 780 - 10 + CAST(l_quantity AS INT) * 14 - 8 AS INT) AS x2,
    CAST((l_suppkey * 53) % 580 - 10 + (l_partkey % 40) * 15 - 3 AS INT) AS y2,
    CAST((l_orderkey * 7 + l_partkey * 13) % 1000 AS DOUBLE) / 1000.0 AS confidence
  FROM lineitem)"""

IMAGES = "images AS (SELECT o_orderkey AS image_id FROM orders)"

CORRECTED = """corrected AS (
  SELECT image_id, CASE WHEN confidence >= 0.95 THEN 'user_avatar' ELSE class END AS class,
    x1, y1, CASE WHEN x2 - x1 > 500 THEN x2 - 20 ELSE x2 END AS x2, y2
  FROM detections WHERE confidence >= 0.05)"""

_MIDDLE = "CAST(floor((y1 + y2) / 2) AS INT)"


def _flat(y1: str) -> str:
    return f"'[' || x1 || ', ' || {y1} || ', ' || x2 || ', ' || y2 || ']'"


def _quoted(name: str, y1: str) -> str:
    return f"""'{{"class": "' || {name} || '", "bbox": ' || {_flat(y1)} || '}}'"""


_BODY = f"""{_quoted('class', 'y1')} || ', ' || {_quoted("'chat_message'", _MIDDLE)}"""

RESPONSES = f"""responses AS (
  SELECT image_id, det_id,
    CASE WHEN confidence < 0.33
        THEN '```json {{"objects": [' || {_BODY} || ']}} ```'
      WHEN confidence < 0.66 THEN 'note {{"objects": [' || {_BODY} || ']}} end'
      ELSE class || ': ' || {_flat('y1')} || '; unknown_part: ' || {_flat(_MIDDLE)}
        || '; chat_message: ' || {_flat(_MIDDLE)} END AS response
  FROM detections)"""

FRAMES = """frames AS (
  SELECT user_id AS stream_id, event_id AS frame_id, ts,
    CAST(event_id % 5 * 4 AS INT) AS x1, CAST(event_id % 3 * 3 AS INT) AS y1,
    CAST(event_id % 5 * 4 + 100 AS INT) AS x2, CAST(event_id % 3 * 3 + 40 AS INT) AS y2,
    event_type AS text, value AS elapsed_ms
  FROM events)"""

FRAME_REGIONS = """frames AS (
  SELECT user_id AS stream_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS frame_id,
    CAST(ts AS DATE) AS ts,
    CAST(event_id % 5 * 4 AS INT) AS x1, CAST(event_id % 3 * 3 AS INT) AS y1,
    CAST(event_id % 5 * 4 + 100 AS INT) AS x2, CAST(event_id % 3 * 3 + 40 AS INT) AS y2,
    event_type AS text
  FROM events)"""

PROFILES = """profiles AS (
  SELECT doc_id AS image_id, CAST(i - 1 AS INT) AS y, CAST(length(p[i]) AS INT) AS ink
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p,
          unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""

TEXT_LINES = """text_lines AS (
  SELECT image_id, line_no, line, effective_width, char_height,
    CAST(trunc(effective_width * (48.0::DOUBLE / char_height)) AS INT) AS scaled_width
  FROM (SELECT doc_id AS image_id, CAST(i - 1 AS INT) AS line_no, p[i] AS line,
      length(p[i]) * 2 + 20 AS effective_width, 14 + length(p[i]) % 60 AS char_height
    FROM (SELECT doc_id, string_split(text, chr(10)) AS p,
            unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)))"""

COMPONENTS = """components AS (
  SELECT image_id, det_id AS comp_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h,
    CAST(floor((x2 - x1) * (y2 - y1) / 2) AS BIGINT) AS area, (y1 + y2) / 2 AS cy
  FROM detections WHERE x2 > x1 AND y2 > y1)"""

STEPS = """steps AS (
  SELECT user_id AS line_id, ts, event_id AS step_id,
    CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 7 END AS INT) AS class_idx,
    round(value / 500.0, 6) AS prob
  FROM events)"""

TIMINGS = """timings AS (
  SELECT 'engine' AS engine, event_type AS config, user_id AS item_id, event_id AS call_id, ts,
    value AS elapsed_ms, value > 1.0 AS ok
  FROM events)"""


def iou(a: str, b: str) -> str:
    """IoU of two boxes given as column prefixes."""
    w = f"(least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    h = f"(least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    union = (
        f"(({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1) - {w} * {h})"
    )
    return (
        f"(CASE WHEN {w} < 0 OR {h} < 0 OR {union} <= 0 THEN 0.0 "
        f"ELSE CAST({w} * {h} AS DOUBLE) / {union} END)"
    )


def using(*views: str) -> str:
    """``WITH`` clause of the given views."""
    return "WITH " + ",\n".join(views) + "\n"
