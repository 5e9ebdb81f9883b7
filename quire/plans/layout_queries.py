"""Queries over layout, geometry, marks and text edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import intake, layout, marks
from quire.plans.leak_queries import _placed_runs
from quire.operators.leaks import excise_runs
from quire.sources import fixtures as fx
from quire.sources.tables import table


def _rows(spark, folder):
    return layout.rows_by_baseline(intake.place_runs(fx.runs(spark, folder)))


def rows_by_baseline(spark, folder):
    return _rows(spark, folder).select("doc_id", "page", "seq", "row_no")


def rows_wandering(spark, folder):
    """Baselines that jump and lie close, so that many runs could belong to several rows."""
    placed = intake.place_runs(fx.runs(spark, folder)).withColumn(
        "y", F.expr("double(82 + (seq * 37 % 97) * 3.125D) - font_size")
    )
    return layout.rows_by_baseline(placed).select("doc_id", "page", "seq", "row_no")


def _line_rows(df):
    return df.select(
        "doc_id", "page", F.col("line_no").cast("long").alias("line_no"), "text", "x",
        F.round("y", 6).alias("y"), F.round("width", 6).alias("width"), "font_size",
        F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
    )


def lines(spark, folder):
    return _line_rows(layout.lines(_rows(spark, folder)))


def _blocks(spark, folder):
    return layout.blocks(layout.lines(_rows(spark, folder)))


def blocks(spark, folder):
    return _blocks(spark, folder).select(
        "doc_id", "page", F.col("block_no").cast("long").alias("block_no"), "n_lines",
        F.md5("text").alias("digest"), "x", F.round("y", 6).alias("y"), F.round("width", 6).alias("width"),
        F.round("height", 6).alias("height"), "font_size", F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
    )


def block_at(spark, folder):
    """Twelve clicks on every page."""
    pages = fx.runs(spark, folder).select("doc_id", "page").distinct()
    points = pages.selectExpr(
        "doc_id", "page", "explode(sequence(0, 11)) AS point"
    ).selectExpr(
        "doc_id", "page", "point", "double(70 + (doc_id * 31 + point * 97) % 500) AS px",
        "double(70 + (doc_id * 17 + point * 61) % 720) AS py",
    )
    return layout.block_at(_blocks(spark, folder), points).withColumn(
        "block_no", F.col("block_no").cast("long")
    )


def locate_citations(spark, folder):
    placed = intake.place_runs(fx.runs(spark, folder))
    sources = fx.runs(spark, folder).select("doc_id", "page").distinct().selectExpr(
        "doc_id", "page", "explode(array(0, 1)) AS cite"
    ).selectExpr("doc_id", "page", "cite", "int(doc_id % 300 + cite * 90) AS start", "int(doc_id % 300 + cite * 90 + 40) AS end")
    return layout.locate_citations(sources, placed).select("doc_id", "page", "cite", "seq", "str")


def _boxes(spark, folder):
    return fx.page_boxes(spark, folder)


def points_to_user(spark, folder):
    points = _boxes(spark, folder).selectExpr(
        "doc_id", "page_index", "double(doc_id * 7 % 400) AS x", "double(page_index * 61 % 500) + 0.5D AS y"
    )
    moved = marks.points_to_user(points, _boxes(spark, folder))
    return moved.select(
        "doc_id", "page_index", "x", "y", *[F.round(c, 6).alias(c) for c in ("ux", "uy", "vx", "vy")]
    )


def rects_to_user(spark, folder):
    rects = _boxes(spark, folder).selectExpr(
        "doc_id", "page_index", "double(doc_id * 7 % 400) AS x", "double(page_index * 61 % 500) AS y",
        "double(10 + doc_id % 50) AS width", "double(5 + page_index) AS height",
    )
    return marks.rects_to_user(rects, _boxes(spark, folder))


def _marks(spark, folder):
    names = ", ".join(f"'{a}'" for a in [*marks.ANCHORS, "middle"])
    return _boxes(spark, folder).selectExpr(
        "doc_id", "page_index", "0 AS mark",
        f"element_at(array({names}), int((doc_id + page_index) % 8 + 1)) AS anchor",
        "CASE WHEN doc_id % 5 = 0 THEN 20.0D END AS margin",
        "CASE WHEN doc_id % 4 = 0 THEN 50.0D END AS x",
        "CASE WHEN doc_id % 6 = 0 THEN 70.0D END AS y",
        "double(100 + doc_id % 37) AS width", "double(20 + page_index) AS height", "double(9) AS ascent",
        "CASE WHEN doc_id % 3 > 0 THEN double(doc_id % 3 * 30) END AS spin",
    )


def place_text(spark, folder):
    placed = marks.place_text(_marks(spark, folder), _boxes(spark, folder))
    return placed.select(
        "doc_id", "page_index", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), "turn", "reason"
    )


def place_images(spark, folder):
    asked = _boxes(spark, folder).selectExpr(
        "doc_id", "page_index", "0 AS mark", "double(doc_id % 90) AS x", "double(page_index * 20) AS y",
        "CASE WHEN doc_id % 3 = 0 THEN double(doc_id % 60) END AS width",
        "CASE WHEN doc_id % 4 < 2 THEN 40.0D END AS height",
        "double(80 + doc_id % 7) AS own_width", "double(60) AS own_height",
    )
    out = marks.place_images(asked, _boxes(spark, folder))
    return out.select(
        "doc_id", "page_index", *[F.round(c, 6).alias(c) for c in ("px", "py", "width", "height")], "turn", "reason"
    )


def watermark_scale(spark, folder):
    asked = _boxes(spark, folder).selectExpr(
        "doc_id", "page_index", "0 AS mark", "double(300 + doc_id * 13 % 900) AS width",
        "double(40 + page_index * 30) AS height", "double(doc_id % 8 * 15) AS spin",
    )
    return marks.watermark_scale(asked, _boxes(spark, folder)).select(
        "doc_id", "page_index", F.round("scale", 9).alias("scale")
    )


def _doc_pages(spark, folder):
    return table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.count("*").alias("n_pages")
    )


def page_labels(spark, folder):
    picked = _boxes(spark, folder).where("(doc_id + page_index) % 3 <> 0").selectExpr(
        "doc_id", "int(CASE WHEN doc_id % 10 = 0 THEN page_index + 4 ELSE page_index END) AS page_index"
    )
    return marks.page_labels(picked, _doc_pages(spark, folder), "Page {n} of {total}", start=7)


def fit_text(spark, folder):
    """Whole documents against a box; widths known for most of their characters."""
    edits = table(spark, folder, "documents").selectExpr(
        "doc_id AS edit", "CASE WHEN doc_id % 50 = 0 THEN '' ELSE text END AS text",
        "n_chars * double(doc_id % 9 - 1) AS room", "double(8 + doc_id % 7) AS size",
        "CASE WHEN doc_id % 4 = 0 THEN 0.9D END AS squeeze",
    )
    # Known: all of Latin-1 but the dollar sign.
    letters = spark.range(10, 256).where("id <> 36").selectExpr("char(id) AS ch", "0.3D + id % 26 * 0.01D AS em")
    out = marks.fit_text(edits, letters)
    return out.select(
        "edit", "fits", F.round("overflow", 6).alias("overflow"), F.round("suggested", 6).alias("suggested"), "warning"
    )


def _edits(spark, folder):
    """An edit for every seventh word: page index within the document's layout."""
    return fx.runs(spark, folder).where("seq % 7 = 3 AND str <> ''").selectExpr(
        "doc_id", "seq AS edit",
        "int(page - 1 + CASE WHEN doc_id % 40 = 0 AND seq = 3 THEN 1000 ELSE 0 END) AS page_index",
        "x + CASE WHEN seq % 5 = 0 THEN 2.0D ELSE 0.75D END AS x", "y", "CASE WHEN seq % 9 = 0 THEN 0.0D ELSE -width END AS width",
        "height", "CASE WHEN seq % 6 = 0 THEN ' ' ELSE str END AS original",
    )


def _planned(spark, folder):
    edits = _edits(spark, folder)
    docs = fx.runs(spark, folder).groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    targets = fx.runs(spark, folder).where("seq % 7 = 3 AND str <> ''").selectExpr(
        "doc_id", "page", "seq AS target", "x + CASE WHEN seq % 5 = 0 THEN 2.0D ELSE 0.75D END AS tx",
        "y + font_size AS ty", "str AS text",
    )
    tried = excise_runs(_placed_runs(spark, folder), targets).selectExpr(
        "doc_id", "target AS edit", "reason IS NULL AS ok"
    )
    return marks.plan_edits(edits, docs, tried)


def plan_edits(spark, folder):
    planned, rejected = _planned(spark, folder)
    return planned.select("doc_id", "edit", "page_index", "action").unionByName(
        rejected.select("doc_id", F.col("reason").alias("action")), allowMissingColumns=True
    )


def edit_counts(spark, folder):
    return marks.edit_counts(_planned(spark, folder)[0])


PLACED = """placed AS (
  SELECT *, CAST(s AS BIGINT) AS start, CAST(s + length(str) AS BIGINT) AS stop FROM (
    SELECT *, coalesce(sum(length(str) + has_eol::INT) OVER (PARTITION BY doc_id, page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM runs)
  WHERE str <> ''),
rowed AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY seq // 8) - 1 AS row_no FROM placed)"""
LINES = f"""{fx.with_('runs')}, {PLACED},
gaps AS (SELECT *, CASE WHEN x - lag(x + width) OVER w > 2.5 * lag(font_size) OVER w THEN 1 ELSE 0 END AS fresh FROM rowed
  WINDOW w AS (PARTITION BY doc_id, page, row_no ORDER BY x)),
cut AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page, row_no ORDER BY x ROWS UNBOUNDED PRECEDING) AS l FROM gaps),
made AS (SELECT doc_id, page, row_no, l, string_agg(str, '' ORDER BY x) AS text, min(x) AS x, max(y + font_size) - max(font_size) AS y,
  max(x + width) - min(x) AS width, max(font_size) * 1.22 AS height, max(font_size) AS font_size, min(start) AS start, max(stop) AS stop
  FROM cut GROUP BY doc_id, page, row_no, l),
lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x, row_no, l) - 1 AS line_no FROM made)"""
BLOCKS = f"""{LINES}, linked AS (
  SELECT *, abs(x - lag(x) OVER w) <= 3 AND abs(font_size - lag(font_size) OVER w) <= 1
    AND y - lag(y + height) OVER w <= 1.9 * lag(font_size) OVER w AND y - lag(y + height) OVER w > -lag(font_size) OVER w AS same
  FROM lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no)),
numbered AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS block_no FROM linked),
blocks AS (SELECT doc_id, page, block_no, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY line_no) AS text, min(x) AS x, min(y) AS y,
  max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, max(font_size) AS font_size, min(start) AS start, max(stop) AS stop
  FROM numbered GROUP BY doc_id, page, block_no)"""

_TURN = "(b.rotation + 720) % 360"
_USER = f"""CASE {_TURN} WHEN 90 THEN {{y}} WHEN 180 THEN b.width - {{x}} WHEN 270 THEN b.width - {{y}} ELSE {{x}} END + b.origin_x AS {{nx}},
  CASE {_TURN} WHEN 90 THEN {{x}} WHEN 180 THEN {{y}} WHEN 270 THEN b.height - {{x}} ELSE b.height - {{y}} END + b.origin_y AS {{ny}}"""
_VIEW = f"CASE WHEN {_TURN} % 180 = 90 THEN b.height ELSE b.width END AS vw, CASE WHEN {_TURN} % 180 = 90 THEN b.width ELSE b.height END AS vh"

EDITED = rf"""{fx.with_('runs')}, base AS (
  SELECT doc_id, page, seq * 2 AS seq, str, x AS px, y + font_size AS py, seq % 13 <> 0 AS placed FROM runs WHERE str <> ''),
laid AS (SELECT * FROM base UNION ALL SELECT doc_id, page, seq + 1, str, px + 1, py, true FROM base WHERE seq % 202 = 0),
linked AS (SELECT *, NOT coalesce(lead(placed) OVER (PARTITION BY doc_id, page ORDER BY seq), true) AS leaning FROM laid),
edits AS (
  SELECT doc_id, page, seq AS edit, CAST(page - 1 + CASE WHEN doc_id % 40 = 0 AND seq = 3 THEN 1000 ELSE 0 END AS INT) AS page_index,
    x + CASE WHEN seq % 5 = 0 THEN 2.0 ELSE 0.75 END AS x, y, y + font_size AS ty, seq % 9 = 0 OR width = 0 AS flat, seq % 6 = 0 AS silent, str
  FROM runs WHERE seq % 7 = 3 AND str <> ''),
tried AS (
  SELECT e.doc_id, e.edit, count(l.seq) = 1 AND NOT bool_or(l.leaning) AND min(l.str) = any_value(e.str) AS ok
  FROM edits e LEFT JOIN linked l ON l.doc_id = e.doc_id AND l.page = e.page AND l.placed AND l.px BETWEEN e.x - 1.5 AND e.x + 1.5
    AND sqrt((l.px - e.x) * (l.px - e.x) + (l.py - e.ty) * (l.py - e.ty)) <= 1.5
  GROUP BY e.doc_id, e.edit),
refused AS (SELECT DISTINCT doc_id FROM edits WHERE page_index >= 1000),
planned AS (SELECT e.doc_id, e.edit, e.page_index, CASE WHEN flat THEN 'skipped' WHEN coalesce(t.ok, false) AND NOT silent THEN 'removed' ELSE 'covered' END AS action
  FROM edits e LEFT JOIN tried t ON t.doc_id = e.doc_id AND t.edit = e.edit WHERE e.doc_id NOT IN (SELECT doc_id FROM refused))"""

QUERIES = {
    "rows_by_baseline": (
        rows_by_baseline,
        f"{fx.with_('runs')}, {PLACED} SELECT doc_id, page, seq, row_no FROM rowed",
    ),
    "rows_wandering": (
        rows_wandering,
        f"""{fx.with_('runs')},
w AS (SELECT doc_id, page, seq, 82 + (seq * 37 % 97) * 3.125::DOUBLE AS b, font_size AS f,
    row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) AS n FROM runs WHERE str <> ''),
walk AS (SELECT doc_id, page, n, seq, [{{'b': b, 'f': f}}] AS leaders, 1::BIGINT AS own FROM w WHERE n = 1
  UNION ALL
  SELECT doc_id, page, n, seq, CASE WHEN hit > 0 THEN leaders ELSE list_append(leaders, {{'b': b, 'f': f}}) END,
    CASE WHEN hit > 0 THEN hit ELSE len(leaders) + 1 END
  FROM (SELECT w.*, leaders, coalesce(list_position(list_transform(leaders, lambda l: abs(l.b - w.b) <= greatest(l.f, w.f) * 0.4::DOUBLE), true), 0) AS hit
    FROM walk JOIN w ON w.doc_id = walk.doc_id AND w.page = walk.page AND w.n = walk.n + 1))
SELECT doc_id, page, seq, own - 1 AS row_no FROM walk""",
    ),
    "lines": (
        lines,
        f"""{LINES} SELECT doc_id, page, line_no, text, x, round(y, 6) AS y, round(width, 6) AS width, font_size, start, stop AS "end" FROM lines""",
    ),
    "blocks": (
        blocks,
        f"""{BLOCKS} SELECT doc_id, page, block_no, n_lines, md5(text) AS digest, x, round(y, 6) AS y, round(width, 6) AS width,
  round(height, 6) AS height, font_size, start, stop AS "end" FROM blocks""",
    ),
    "block_at": (
        block_at,
        f"""{BLOCKS}, pts AS (SELECT doc_id, page, point, 70 + (doc_id * 31 + point * 97) % 500 AS px, 70 + (doc_id * 17 + point * 61) % 720 AS py
  FROM (SELECT doc_id, page, CAST(unnest(range(12)) AS INT) AS point FROM (SELECT DISTINCT doc_id, page FROM runs)))
SELECT p.doc_id, p.page, p.point, b.block_no FROM pts p JOIN blocks b ON b.doc_id = p.doc_id AND b.page = p.page
  AND px >= x - 2 AND px <= x + width + 2 AND py >= y - 2 AND py <= y + height + 2
QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.page, p.point ORDER BY width * height, b.block_no) = 1""",
    ),
    "locate_citations": (
        locate_citations,
        f"""{fx.with_('runs')}, {PLACED.replace('AS (', 'AS MATERIALIZED (', 1)},
src AS (SELECT doc_id, page, cite, doc_id % 300 + cite * 90 AS a, doc_id % 300 + cite * 90 + 40 AS b
  FROM (SELECT DISTINCT doc_id, page FROM placed) CROSS JOIN (SELECT 0 AS cite UNION ALL SELECT 1)),
met AS MATERIALIZED (SELECT p.doc_id, p.page, s.cite, p.seq, p.str, p.start, p.stop, s.a, s.b FROM placed p JOIN src s ON s.doc_id = p.doc_id AND s.page = p.page)
SELECT doc_id, page, cite, seq, str FROM met WHERE start < b AND stop > a""",
    ),
    "points_to_user": (
        points_to_user,
        f"""{fx.with_('page_boxes')}, p AS (SELECT *, CAST(doc_id * 7 % 400 AS DOUBLE) AS x, page_index * 61 % 500 + 0.5::DOUBLE AS y FROM page_boxes),
u AS (SELECT *, {_USER.format(x='b.x', y='b.y', nx='ux', ny='uy')} FROM p b)
SELECT doc_id, page_index, x, y, round(ux, 6) AS ux, round(uy, 6) AS uy, x AS vx, y AS vy FROM u""",
    ),
    "rects_to_user": (
        rects_to_user,
        f"""{fx.with_('page_boxes')}, p AS (SELECT *, CAST(doc_id * 7 % 400 AS DOUBLE) AS x, CAST(page_index * 61 % 500 AS DOUBLE) AS y,
  CAST(10 + doc_id % 50 AS DOUBLE) AS w, CAST(5 + page_index AS DOUBLE) AS h FROM page_boxes),
c AS (SELECT *, {_USER.format(x='b.x', y='b.y', nx='ax', ny='ay')}, {_USER.format(x='(b.x + b.w)', y='(b.y + b.h)', nx='cx', ny='cy')} FROM p b)
SELECT doc_id, page_index, least(ax, cx) AS x, least(ay, cy) AS y, abs(cx - ax) AS width, abs(cy - ay) AS height FROM c""",
    ),
    "place_text": (
        place_text,
        f"""{fx.with_('page_boxes')}, m AS (
  SELECT *, (doc_id + page_index) % 8 AS k, CASE WHEN doc_id % 5 = 0 THEN 20.0 ELSE 36.0 END::DOUBLE AS margin, CAST(100 + doc_id % 37 AS DOUBLE) AS w,
    CAST(20 + page_index AS DOUBLE) AS h, CAST(doc_id % 3 * 30 AS DOUBLE) AS spin, {_VIEW} FROM page_boxes b),
a AS (
  SELECT *, CASE WHEN doc_id % 4 = 0 THEN 50 WHEN k IN (0, 4) THEN margin WHEN k IN (2, 6) THEN vw - w - margin ELSE (vw - w) / 2 END AS l,
    CASE WHEN doc_id % 6 = 0 THEN 70 WHEN k <= 2 THEN margin WHEN k BETWEEN 4 AND 6 THEN vh - h - margin ELSE (vh - h) / 2 END AS t FROM m),
s AS (
  SELECT *, l + w / 2 - w / 2 * cos(radians(spin)) + (9 - h / 2) * sin(radians(spin)) AS x,
    t + h / 2 + w / 2 * sin(radians(spin)) + (9 - h / 2) * cos(radians(spin)) AS y FROM a),
u AS (SELECT *, {_USER.format(x='b.x', y='b.y', nx='ux', ny='uy')} FROM s b)
SELECT doc_id, page_index, CASE WHEN k < 7 THEN round(ux, 6) END AS px, CASE WHEN k < 7 THEN round(uy, 6) END AS py,
  CASE WHEN k < 7 THEN (rotation + 720) % 360 + spin END AS turn, CASE WHEN k = 7 THEN 'no-such-anchor' END AS reason FROM u""",
    ),
    "place_images": (
        place_images,
        f"""{fx.with_('page_boxes')}, m AS (
  SELECT *, CASE WHEN doc_id % 3 = 0 THEN doc_id % 60 END::DOUBLE AS aw, CASE WHEN doc_id % 4 < 2 THEN 40 END::DOUBLE AS ah, (80 + doc_id % 7)::DOUBLE AS ow FROM page_boxes),
s AS (SELECT *, coalesce(aw, ah * ow / 60, ow) AS w, coalesce(ah, aw * 60 / ow, 60) AS h FROM m),
p AS (SELECT *, CAST(doc_id % 90 AS DOUBLE) AS x, page_index * 20 + h AS y FROM s),
u AS (SELECT *, {_USER.format(x='b.x', y='b.y', nx='ux', ny='uy')} FROM p b)
SELECT doc_id, page_index, CASE WHEN w > 0 AND h > 0 THEN round(ux, 6) END AS px, CASE WHEN w > 0 AND h > 0 THEN round(uy, 6) END AS py,
  CASE WHEN w > 0 AND h > 0 THEN round(w, 6) END AS width, CASE WHEN w > 0 AND h > 0 THEN round(h, 6) END AS height,
  CASE WHEN w > 0 AND h > 0 THEN (rotation + 720) % 360 END AS turn, CASE WHEN NOT (w > 0 AND h > 0) THEN 'no-size' END AS reason FROM u""",
    ),
    "watermark_scale": (
        watermark_scale,
        f"""{fx.with_('page_boxes')}, m AS (
  SELECT *, 300 + doc_id * 13 % 900 AS w, 40 + page_index * 30 AS h, abs(cos(radians(doc_id % 8 * 15))) AS c, abs(sin(radians(doc_id % 8 * 15))) AS s, {_VIEW} FROM page_boxes b)
SELECT doc_id, page_index, round(least(1, vw / (w * c + h * s), vh / (w * s + h * c)), 9) AS scale FROM m""",
    ),
    "page_labels": (
        page_labels,
        f"""{fx.with_('page_boxes')}, d AS (SELECT doc_id, count(*) AS n FROM page_boxes GROUP BY doc_id),
s AS (SELECT DISTINCT b.doc_id, CAST(CASE WHEN b.doc_id % 10 = 0 THEN page_index + 4 ELSE page_index END AS INT) AS page_index, n FROM page_boxes b JOIN d ON d.doc_id = b.doc_id
  WHERE (b.doc_id + page_index) % 3 <> 0)
SELECT doc_id, page_index, 'Page ' || (6 + row_number() OVER (PARTITION BY doc_id ORDER BY page_index)) || ' of ' || (6 + count(*) OVER (PARTITION BY doc_id)) AS label
FROM s WHERE page_index < n""",
    ),
    "fit_text": (
        fit_text,
        """WITH RECURSIVE e AS (
  SELECT doc_id AS edit, CASE WHEN doc_id % 50 = 0 THEN '' ELSE text END AS text, abs(CAST(n_chars * (doc_id % 9 - 1) AS DOUBLE)) AS room,
    CAST(8 + doc_id % 7 AS DOUBLE) AS size, CASE WHEN doc_id % 4 = 0 THEN 0.9 ELSE 1.0 END::DOUBLE AS q FROM documents),
ch AS (SELECT edit, c, count(*) AS n FROM (SELECT edit, unnest(string_split(text, '')) AS c FROM e) GROUP BY edit, c),
em AS (SELECT edit, sum(n * (0.3::DOUBLE + unicode(c) % 26 * 0.01::DOUBLE)) AS s, bool_or(unicode(c) NOT BETWEEN 10 AND 255 OR c = '$') AS missing
  FROM ch WHERE c <> '' GROUP BY edit),
w AS (SELECT e.*, q * coalesce(s, 0) AS ems, coalesce(missing, false) AS missing FROM e LEFT JOIN em USING (edit)),
bis AS (
  SELECT edit, 0 AS i, size * 0.6 AS low, size AS high FROM w
  UNION ALL SELECT b.edit, i + 1, CASE WHEN ems * (low + high) / 2 <= room THEN (low + high) / 2 ELSE low END,
    CASE WHEN ems * (low + high) / 2 <= room THEN high ELSE (low + high) / 2 END FROM bis b JOIN w ON w.edit = b.edit WHERE i < 20),
f AS (SELECT w.*, CASE WHEN NOT room > 0 OR text = '' OR ems * size <= room THEN size ELSE floor(low * 100 + 1e-6) / 100 END AS sug FROM w JOIN bis b ON b.edit = w.edit AND i = 20)
SELECT edit, NOT missing AND ems * size <= room AS fits, CASE WHEN NOT missing THEN round(greatest(ems * size - room, 0), 6) END AS overflow,
  CASE WHEN NOT missing THEN round(sug, 6) END AS suggested,
  CASE WHEN missing THEN 'no-such-glyph' WHEN ems * size <= room THEN NULL WHEN ems * sug > room THEN 'overflows' ELSE 'shrunk' END AS warning FROM f""",
    ),
    "plan_edits": (
        plan_edits,
        f"""{EDITED} SELECT doc_id, edit, page_index, action FROM planned UNION ALL SELECT doc_id, NULL, NULL, 'no-such-page' FROM refused""",
    ),
    "edit_counts": (
        edit_counts,
        f"""{EDITED} SELECT doc_id, count(*) FILTER (WHERE action <> 'skipped') AS applied, count(*) FILTER (WHERE action = 'removed') AS removed,
  count(*) FILTER (WHERE action = 'covered') AS covered, count(*) FILTER (WHERE action = 'skipped') AS skipped FROM planned GROUP BY doc_id""",
    ),
}
