"""Queries over form, metadata, size and traffic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import forms, intake, metadata, sizes
from quire.sources import fixtures as fx
from quire.sources.tables import table


def _lists(text: str, spark_side: bool) -> str:
    """List literals are written <a, b>; spell them for the engine at hand."""
    opened, closed = ("array(", ")") if spark_side else ("[", "]")
    empty = "cast(array() AS array<string>)" if spark_side else "CAST([] AS VARCHAR[])"
    spelled = text.replace("<>", "{none}").replace("<", opened).replace(">", closed)
    return spelled.replace("{none}", empty)


_FIELDS = """
SELECT c_custkey AS doc_id, 0 AS seq, 'name' AS name, 'text' AS type, c_name AS v_text, CAST(NULL AS BOOLEAN) AS v_bool, <> AS v_list, <> AS options,
  false AS multiple, false AS editable, false AS read_only, true AS required, 20 AS max_length, 0 AS flags, 1 AS page FROM {c}
UNION ALL SELECT c_custkey, 1, 'segment', 'dropdown', NULL, NULL, <c_mktsegment>, <'AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'>,
  false, c_custkey % 5 = 0, false, false, NULL, 0, 1 FROM {c}
UNION ALL SELECT c_custkey, 2, 'vip', 'checkbox', NULL, c_custkey % 3 = 1, <>, <>, false, false, false, c_custkey % 2 = 0, NULL, 0, 1 FROM {c}
UNION ALL SELECT c_custkey, 3, 'region', 'radio', CASE c_nationkey % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE '' END, NULL, <>, <'north', 'south'>,
  false, false, false, true, NULL, 0, 1 FROM {c}
UNION ALL SELECT c_custkey, 4, 'tags', 'optionlist', NULL, NULL, CASE c_custkey % 3 WHEN 0 THEN <> WHEN 1 THEN <'a'> ELSE <'a', 'b'> END, <'a', 'b', 'c'>,
  c_custkey % 2 = 0, false, false, true, NULL, 0, 2 FROM {c}
UNION ALL SELECT c_custkey, 5, 'sign', 'signature', NULL, NULL, <>, <>, false, false, false, true, NULL, 0, 2 FROM {c}
UNION ALL SELECT c_custkey, 6, 'name', 'text', CASE WHEN c_custkey % 5 = 1 THEN '' ELSE c_name END, NULL, <>, <>, false, false, c_custkey % 3 = 0, false, NULL,
  CASE WHEN c_custkey % 4 = 0 THEN 6 ELSE 4 END, 2 FROM {c}"""

_VALUES = """
SELECT c_custkey AS doc_id, 'name' AS name, 'text' AS kind, CASE WHEN c_custkey % 6 = 0 THEN concat(c_name, ' and more') WHEN c_custkey % 5 = 0 THEN c_name ELSE concat('n', c_custkey) END AS v_text,
  CAST(NULL AS BOOLEAN) AS v_bool, <> AS v_list FROM {c}
UNION ALL SELECT c_custkey, 'segment', CASE c_custkey % 7 WHEN 0 THEN 'bool' WHEN 1 THEN 'list' ELSE 'text' END, CASE WHEN c_custkey % 7 = 2 THEN 'OTHER' ELSE 'BUILDING' END,
  true, <'BUILDING', 'MACHINERY'> FROM {c}
UNION ALL SELECT c_custkey, 'vip', CASE WHEN c_custkey % 13 = 0 THEN 'text' ELSE 'bool' END, 'yes', c_custkey % 2 = 0, <> FROM {c}
UNION ALL SELECT c_custkey, 'region', 'text', CASE c_custkey % 8 WHEN 0 THEN '' WHEN 2 THEN 'east' WHEN 3 THEN 'south' ELSE 'north' END, NULL, <> FROM {c}
UNION ALL SELECT c_custkey, 'tags', 'list', NULL, NULL, CASE c_custkey % 6 WHEN 0 THEN <'a', 'c'> WHEN 5 THEN <'z'> WHEN 2 THEN <'a', 'b'> ELSE <> END FROM {c}
UNION ALL SELECT c_custkey, 'ghost', 'text', 'boo', NULL, <> FROM {c} WHERE c_custkey % 9 = 0
UNION ALL SELECT c_custkey, 'sign', 'text', 'me', NULL, <> FROM {c} WHERE c_custkey % 10 = 0"""

_F_SQL = "fields AS (SELECT * FROM (" + _lists(_FIELDS, False).format(c="customer") + ") WHERE doc_id % 11 <> 0)"
_V_SQL = "vals AS (SELECT * FROM (" + _lists(_VALUES, False).format(c="customer") + ") WHERE doc_id % 8 <> 7)"
_FV = f"WITH {_F_SQL}, {_V_SQL}"


def _fields(spark, folder):
    c = table(spark, folder, "customer")
    return spark.sql(_lists(_FIELDS, True), c=c).where("doc_id % 11 <> 0")


def _values(spark, folder):
    c = table(spark, folder, "customer")
    return spark.sql(_lists(_VALUES, True), c=c).where("doc_id % 8 <> 7")


def _joined(column):
    return F.array_join(column, ",").alias(column)


def form_catalog(spark, folder):
    return forms.form_catalog(_fields(spark, folder)).select(
        "doc_id", "seq", "name", "type", "v_text", "v_bool", _joined("v_list"), _joined("options"),
        "multiple", "editable", "read_only", "required", "page",
    )


def form_summary(spark, folder):
    docs = table(spark, folder, "customer").selectExpr("c_custkey AS doc_id")
    return forms.form_summary(docs, _fields(spark, folder))


def validate_fill(spark, folder):
    return forms.validate_fill(_fields(spark, folder), _values(spark, folder))


def apply_fill(spark, folder):
    return forms.apply_fill(_fields(spark, folder), _values(spark, folder)).select(
        "doc_id", "seq", "v_text", "v_bool", _joined("v_list")
    )


def fill_changes(spark, folder):
    return forms.fill_changes(_fields(spark, folder), _values(spark, folder)).select("doc_id", "name", "kind")


def required_blank(spark, folder):
    return forms.required_blank(_fields(spark, folder), _values(spark, folder))


def flatten_fields(spark, folder):
    return forms.flatten_fields(_fields(spark, folder))


def _merge_in(spark, folder):
    """Fields of documents merged by source: names repeat, some carry numbers."""
    return table(spark, folder, "documents").selectExpr(
        "doc_id % 10 AS out_doc", "doc_id div 10 AS input_ord",
        """inline(array(
          named_struct('seq', 0, 'root', 1, 'name', concat('f', doc_id div 10 % 4), 'has_kids', false),
          named_struct('seq', 1, 'root', 1, 'name', concat('f', doc_id div 10 % 4), 'has_kids', false),
          named_struct('seq', 2, 'root', 2, 'name', CASE doc_id div 10 % 5 WHEN 0 THEN '' WHEN 1 THEN 'Field' WHEN 2 THEN 'f1 (2)' WHEN 3 THEN 'f2 (2) (2)' ELSE 'g' END,
                       'has_kids', doc_id div 10 % 10 = 5)))""",
    )


def merge_fields(spark, folder):
    return forms.merge_fields(_merge_in(spark, folder))


def _info(spark, folder):
    """Info dictionaries made of document properties, some entries malformed."""
    return table(spark, folder, "documents").selectExpr(
        "doc_id",
        """map('Title', named_struct('kind', CASE WHEN doc_id % 7 = 0 THEN 'number' ELSE 'string' END, 'value', text),
          'Author', named_struct('kind', 'string', 'value', source),
          'Keywords', named_struct('kind', 'string', 'value', CASE doc_id % 4 WHEN 0 THEN concat(' a, b c ;', lang, ',,') WHEN 1 THEN concat('one  two ', lang) WHEN 2 THEN '' ELSE ' , ' END),
          'CreationDate', named_struct('kind', 'string', 'value', CASE doc_id % 5 WHEN 0 THEN 'last Tuesday' WHEN 1 THEN concat('D:2024', lpad(string(doc_id % 12 + 1), 2, '0'), '0312')
             WHEN 2 THEN "D:20240229101530+02'30'" WHEN 3 THEN 'D:20241399000000Z' ELSE '2023-05-06 07:08:09' END),
          CASE WHEN doc_id % 2 = 0 THEN 'ModDate' ELSE 'Company' END, named_struct('kind', 'string', 'value', 'D:2022-')) AS info""",
        "int(n_chars % 300 + 1) AS n_pages", "CASE WHEN doc_id % 6 = 0 THEN true END AS encrypted",
    )


def read_metadata(spark, folder):
    return metadata.read_metadata(_info(spark, folder)).select(
        "doc_id", "title", "author", "subject", "creator", "producer",
        F.array_join("keywords", "|").alias("keywords"),
        F.unix_timestamp("created").alias("created_s"), F.unix_timestamp("modified").alias("modified_s"),
        "n_pages", "encrypted",
    )


def split_keywords(spark, folder):
    raw = F.expr(
        "CASE doc_id % 4 WHEN 0 THEN replace(text, ' ', '; ') WHEN 1 THEN text WHEN 2 THEN NULL ELSE concat(' ', source, ' ,', lang) END"
    )
    words = metadata.split_keywords(raw)
    return table(spark, folder, "documents").select(
        "doc_id", F.size(words).cast("long").alias("n"), F.array_join(words, "|").alias("words")
    )


def _meta(spark, folder):
    return table(spark, folder, "documents").selectExpr(
        "doc_id", "text AS title", "source AS author", "lang AS subject", "'Writer' AS creator",
        "cast(NULL AS string) AS producer", "'old, words' AS keywords",
        "timestamp_seconds(n_chars) AS created", "timestamp_seconds(0) AS modified", "'<xmp/>' AS xmp",
    )


def _patches(spark, folder):
    return table(spark, folder, "documents").where("doc_id % 9 <> 8").selectExpr(
        "doc_id",
        """CASE doc_id % 6
             WHEN 0 THEN map('title', 'New', 'author', '')
             WHEN 1 THEN map('keywords', ' a ; b c,', 'created', '')
             WHEN 2 THEN map('modified', '2024-02-03 04:05:06', 'producer', lang)
             WHEN 3 THEN map('created', 'not a date', 'title', 'x')
             WHEN 4 THEN map('n_pages', '4', 'encrypted', 'true')
             ELSE map('keywords', ' , ', 'subject', '') END AS patch""",
    )


def _meta_rows(df):
    return df.withColumn("created_s", F.unix_timestamp("created")).withColumn(
        "modified_s", F.unix_timestamp("modified")
    ).drop("created", "modified")


def patch_metadata(spark, folder):
    return _meta_rows(metadata.patch_metadata(_meta(spark, folder), _patches(spark, folder)))


def rejected_patches(spark, folder):
    return metadata.rejected_patches(_patches(spark, folder))


def strip_metadata(spark, folder):
    return _meta_rows(metadata.strip_metadata(_meta(spark, folder)))


def _candidates(spark, folder):
    """Two recompressions per order: sizes from its price."""
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS doc_id",
        """inline(array(
          named_struct('method', 'tidy', 'before', bigint(o_totalprice), 'after', bigint(o_totalprice * (0.985D + o_orderkey % 5 * 0.004D))),
          named_struct('method', 'flatten', 'before', bigint(o_totalprice), 'after', bigint(o_totalprice * (0.6D + o_custkey % 10 * 0.06D)))))""",
    )


def keep_smaller(spark, folder):
    out = sizes.keep_smaller(_candidates(spark, folder))
    return out.withColumn("saved", F.round("saved", 9))


def size_delta(spark, folder):
    kept = sizes.keep_smaller(_candidates(spark, folder))
    change = sizes.size_delta(F.col("before").cast("double"), F.col("after").cast("double"))
    return kept.select("doc_id", change.alias("delta"))


def size_totals(spark, folder):
    return sizes.size_totals(sizes.keep_smaller(_candidates(spark, folder)))


def flatten_estimate(spark, folder):
    docs = table(spark, folder, "documents").selectExpr("doc_id", "n_chars div 20 AS n_pages")
    dpi = F.expr("CASE WHEN doc_id % 5 = 0 THEN double('NaN') ELSE double(36 + doc_id % 300) END")
    return sizes.flatten_estimate(docs, dpi)


def rebuild_losses(spark, folder):
    flags = [f"(doc_id * {p} + n_chars) % {m} = 0 AS {c}" for (c, _), p, m in zip(
        sizes.LOSSES, (3, 5, 7, 11, 13, 17, 19, 23, 29), (2, 3, 4, 5, 3, 2, 5, 4, 3))]
    features = table(spark, folder, "documents").selectExpr("doc_id", *flags, "doc_id % 4 = 0 AS signed")
    return sizes.rebuild_losses(features).select("doc_id", F.array_join("losses", ", ").alias("losses"), "signed")


def _requests(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "user_id AS session", "cast(ts AS timestamp) AS ts", "bigint(value * 100) AS bytes",
        """CASE event_type WHEN 'click' THEN concat('https://Me@A', event_id % 5, '.Example.com:443/x?q=', event_id)
             WHEN 'view' THEN concat('http://b', event_id % 3, '.example.org:8080/')
             WHEN 'signup' THEN concat('/local/', event_id) WHEN 'error' THEN 'blob:https://a.example/1'
             ELSE 'https://bad host/%%' END AS url""",
    )


def traffic(spark, folder):
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    loads = events.groupBy(F.col("user_id").alias("session")).agg(F.min("ts").alias("loaded_at")).withColumn(
        "host", F.concat(F.lit("own"), F.col("session") % 2)
    )
    uploads = events.where("event_type = 'purchase'").selectExpr("user_id AS session", "bigint(value) AS bytes")
    out = sizes.traffic(_requests(spark, folder), loads, uploads)
    return out.withColumn("hosts", F.array_join("hosts", ","))


def plan_export(spark, folder):
    shapes = intake.page_shapes(fx.page_boxes(spark, folder)).withColumn("page_index", F.col("page") - 1)
    grown = shapes.withColumn("view_width", F.expr("view_width * CASE WHEN doc_id % 9 = 0 THEN 10 ELSE 1 END"))
    picked = shapes.where("(doc_id + page_index) % 2 = 0").select("doc_id", "page_index")
    asked = table(spark, folder, "conversations").where("turn = 0").selectExpr(
        "conv_id AS doc_id", "concat('a:', conv_id) AS base", "double(20 + conv_id % 30 * 21) AS dpi",
        "CASE WHEN conv_id % 2 = 0 THEN 'png' ELSE 'jpg' END AS extension",
    )
    return sizes.plan_export(grown, picked, asked)


_META_SQL = """meta AS (SELECT doc_id, text AS title, source AS author, lang AS subject, n_chars AS created_s, doc_id % 6 AS k, doc_id % 9 = 8 AS none, lang FROM documents)"""
_CAND = """cand AS (
  SELECT o_orderkey AS doc_id, 'tidy' AS method, o_totalprice AS p, o_totalprice * (0.985::DOUBLE + (o_orderkey % 5) * 0.004::DOUBLE) AS q FROM orders
  UNION ALL SELECT o_orderkey, 'flatten', o_totalprice, o_totalprice * (0.6::DOUBLE + (o_custkey % 10) * 0.06::DOUBLE) FROM orders),
sized AS (SELECT doc_id, method, CAST(trunc(p) AS BIGINT) AS before, CAST(trunc(q) AS BIGINT) AS after FROM cand),
best AS (SELECT * FROM sized QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY after, method) = 1),
kept AS (SELECT doc_id, method, before, least(before, after) AS after, CASE WHEN after < before THEN (before - after) / before ELSE 0 END AS saved, after < before AS smaller FROM best)"""
_DELTA = """CASE WHEN {b} <= 0 THEN '' WHEN abs(({a} - {b}) / {b} * 100) < 0.5 THEN 'no change' WHEN {a} < {b} THEN CAST(floor(({a} - {b}) / {b} * 100 + 0.5) AS BIGINT) || '%'
  ELSE '+' || CAST(floor(({a} - {b}) / {b} * 100 + 0.5) AS BIGINT) || '%' END"""

QUERIES = {
    "form_catalog": (
        form_catalog,
        f"""WITH {_F_SQL} SELECT doc_id, seq, name, type, CASE WHEN type IN ('text', 'radio') THEN v_text END AS v_text, CASE WHEN type = 'checkbox' THEN v_bool END AS v_bool,
  CASE WHEN type IN ('dropdown', 'optionlist') THEN array_to_string(v_list, ',') END AS v_list,
  CASE WHEN type IN ('dropdown', 'optionlist', 'radio') THEN array_to_string(options, ',') END AS options,
  CASE WHEN type IN ('dropdown', 'optionlist') THEN multiple END AS multiple, CASE WHEN type = 'dropdown' THEN editable END AS editable, read_only, required, page FROM fields""",
    ),
    "form_summary": (
        form_summary,
        f"""WITH {_F_SQL} SELECT c.c_custkey AS doc_id, count(f.seq) > 0 AS has_form, count(f.seq) AS n_fields,
  count(f.seq) FILTER (WHERE f.type <> 'signature') AS n_fillable, count(f.seq) FILTER (WHERE f.required) AS n_required, count(f.seq) FILTER (WHERE f.read_only) AS n_read_only
FROM customer c LEFT JOIN fields f ON f.doc_id = c.c_custkey GROUP BY c.c_custkey""",
    ),
    "validate_fill": (
        validate_fill,
        f"""{_FV} SELECT doc_id, 'name' AS name, 0 AS seq, 'too-long' AS reason FROM vals WHERE name = 'name' AND length(v_text) > 20 AND doc_id % 11 <> 0
UNION ALL SELECT doc_id, name, 1, CASE WHEN kind = 'bool' THEN 'wrong-shape' WHEN kind = 'list' THEN 'one-choice-only' ELSE 'not-offered' END FROM vals
  WHERE name = 'segment' AND doc_id % 11 <> 0 AND (kind <> 'text' OR (v_text = 'OTHER' AND doc_id % 5 <> 0))
UNION ALL SELECT doc_id, name, 2, 'wrong-shape' FROM vals WHERE name = 'vip' AND kind = 'text' AND doc_id % 11 <> 0
UNION ALL SELECT doc_id, name, 3, 'not-offered' FROM vals WHERE name = 'region' AND v_text = 'east' AND doc_id % 11 <> 0
UNION ALL SELECT doc_id, name, 4, CASE WHEN len(v_list) > 1 THEN 'one-choice-only' ELSE 'not-offered' END FROM vals
  WHERE name = 'tags' AND doc_id % 11 <> 0 AND ((len(v_list) > 1 AND doc_id % 2 = 1) OR list_contains(v_list, 'z'))
UNION ALL SELECT doc_id, name, 5, 'holds-no-value' FROM vals WHERE name = 'sign' AND doc_id % 11 <> 0
UNION ALL SELECT doc_id, name, NULL, 'no-such-field' FROM vals WHERE name = 'ghost' AND doc_id % 11 <> 0
UNION ALL SELECT doc_id, name, NULL, 'no-form' FROM vals WHERE doc_id % 11 = 0""",
    ),
    "apply_fill": (
        apply_fill,
        f"""{_FV}, bad AS (
  SELECT DISTINCT doc_id FROM vals WHERE (name = 'name' AND length(v_text) > 20) OR (name = 'segment' AND (kind <> 'text' OR (v_text = 'OTHER' AND doc_id % 5 <> 0)))
    OR (name = 'vip' AND kind = 'text') OR (name = 'region' AND v_text = 'east') OR (name = 'tags' AND ((len(v_list) > 1 AND doc_id % 2 = 1) OR list_contains(v_list, 'z')))
    OR name IN ('sign', 'ghost'))
SELECT f.doc_id, f.seq, CASE WHEN v.name IS NOT NULL AND f.type IN ('text', 'radio') THEN v.v_text ELSE f.v_text END AS v_text,
  CASE WHEN v.name IS NOT NULL AND f.type = 'checkbox' THEN v.v_bool ELSE f.v_bool END AS v_bool,
  array_to_string(CASE WHEN v.name IS NOT NULL AND f.type = 'optionlist' THEN v.v_list WHEN v.name IS NOT NULL AND f.type = 'dropdown' THEN [v.v_text] ELSE f.v_list END, ',') AS v_list
FROM fields f LEFT JOIN vals v ON v.doc_id = f.doc_id AND v.name = f.name AND v.doc_id NOT IN (SELECT doc_id FROM bad)""",
    ),
    "fill_changes": (
        fill_changes,
        f"""{_FV} SELECT DISTINCT f.doc_id, f.name, v.kind FROM fields f JOIN vals v ON v.doc_id = f.doc_id AND v.name = f.name
WHERE f.type <> 'signature' AND NOT f.read_only AND NOT CASE f.type WHEN 'checkbox' THEN v.kind = 'bool' AND v.v_bool = f.v_bool WHEN 'optionlist' THEN v.v_list = f.v_list
  WHEN 'dropdown' THEN v.kind = 'text' AND v.v_text = f.v_list[1] ELSE v.v_text = f.v_text END""",
    ),
    "required_blank": (
        required_blank,
        f"""{_FV} SELECT f.doc_id, count(*) AS n_required, count(*) FILTER (WHERE CASE
    WHEN v.name IS NULL THEN CASE f.type WHEN 'checkbox' THEN NOT f.v_bool WHEN 'optionlist' THEN len(f.v_list) = 0 ELSE f.v_text = '' END
    WHEN v.kind = 'bool' THEN NOT v.v_bool WHEN v.kind = 'text' THEN v.v_text = '' ELSE len(v.v_list) = 0 END) AS n_blank
FROM fields f LEFT JOIN vals v ON v.doc_id = f.doc_id AND v.name = f.name WHERE f.required AND f.type <> 'signature' GROUP BY f.doc_id""",
    ),
    "flatten_fields": (
        flatten_fields,
        f"""WITH {_F_SQL}, t AS (SELECT doc_id, page, seq, CASE type WHEN 'checkbox' THEN CASE WHEN v_bool THEN 'X' END WHEN 'dropdown' THEN array_to_string(v_list, ', ')
  WHEN 'optionlist' THEN array_to_string(v_list, ', ') WHEN 'signature' THEN NULL ELSE v_text END AS str FROM fields WHERE flags <> 6)
SELECT * FROM t WHERE str <> ''""",
    ),
    "merge_fields": (
        merge_fields,
        r"""WITH RECURSIVE src AS (
  SELECT doc_id % 10 AS out_doc, doc_id // 10 AS input_ord, 1 AS root, 'f' || (doc_id // 10 % 4) AS had, false AS kids FROM documents
  UNION ALL SELECT doc_id % 10, doc_id // 10, 2, CASE doc_id // 10 % 5 WHEN 0 THEN '' WHEN 1 THEN 'Field' WHEN 2 THEN 'f1 (2)' WHEN 3 THEN 'f2 (2) (2)' ELSE 'g' END, doc_id // 10 % 10 = 5 FROM documents),
named AS (SELECT *, CASE WHEN had <> '' THEN had WHEN kids THEN '' ELSE 'Field' END AS name FROM src),
ordered AS (SELECT *, row_number() OVER (PARTITION BY out_doc ORDER BY input_ord, root) AS i FROM named WHERE name <> ''),
walk AS (
  SELECT out_doc, input_ord, root, had, i, name AS new_name, [name] AS used FROM ordered WHERE i = 1
  UNION ALL
  SELECT out_doc, input_ord, root, had, i, pick, list_append(used, pick) FROM (
    SELECT n.*, w.used, CASE WHEN NOT list_contains(w.used, n.name) THEN n.name
      ELSE n.name || ' (' || list_filter(range(2, len(w.used) + 3), lambda k: NOT list_contains(w.used, n.name || ' (' || k || ')'))[1] || ')' END AS pick
    FROM walk w JOIN ordered n ON n.out_doc = w.out_doc AND n.i = w.i + 1))
SELECT out_doc, input_ord, root, new_name, had <> '' AND new_name <> had AS renamed FROM walk
UNION ALL SELECT out_doc, input_ord, root, '', false FROM named WHERE name = ''""",
    ),
    "read_metadata": (
        read_metadata,
        r"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS title, source AS author, '' AS subject, '' AS creator, '' AS producer,
  CASE doc_id % 4 WHEN 0 THEN 'a|b c|' || lang WHEN 1 THEN 'one|two|' || lang ELSE '' END AS keywords,
  CASE doc_id % 5 WHEN 1 THEN epoch(make_timestamp(2024, doc_id % 12 + 1, 3, 12, 0, 0.0))::BIGINT
    WHEN 2 THEN epoch(TIMESTAMP '2024-02-29 07:45:30')::BIGINT WHEN 4 THEN epoch(TIMESTAMP '2023-05-06 07:08:09')::BIGINT END AS created_s,
  CAST(NULL AS BIGINT) AS modified_s, CAST(n_chars % 300 + 1 AS INT) AS n_pages, doc_id % 6 = 0 AS encrypted FROM documents""",
    ),
    "split_keywords": (
        split_keywords,
        r"""WITH raw AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, ' ', '; ') WHEN 1 THEN text WHEN 2 THEN NULL ELSE ' ' || source || ' ,' || lang END AS r FROM documents),
l AS (SELECT doc_id, coalesce(list_filter(list_transform(CASE WHEN regexp_matches(r, '[,;]') THEN string_split_regex(r, '[,;]') ELSE string_split_regex(r, '\s+') END,
  lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''), []) AS w FROM raw)
SELECT doc_id, len(w) AS n, array_to_string(w, '|') AS words FROM l""",
    ),
    "patch_metadata": (
        patch_metadata,
        f"""WITH {_META_SQL} SELECT doc_id, CASE WHEN NOT none AND k = 0 THEN 'New' ELSE title END AS title, CASE WHEN NOT none AND k = 0 THEN NULL ELSE author END AS author,
  CASE WHEN NOT none AND k = 5 THEN NULL ELSE subject END AS subject, 'Writer' AS creator, CASE WHEN NOT none AND k = 2 THEN lang END AS producer,
  CASE WHEN none THEN 'old, words' WHEN k = 1 THEN 'a, b c' WHEN k = 5 THEN NULL ELSE 'old, words' END AS keywords,
  CASE WHEN NOT none AND k = 1 THEN NULL ELSE created_s END AS created_s, CASE WHEN NOT none AND k = 2 THEN epoch(TIMESTAMP '2024-02-03 04:05:06')::BIGINT ELSE 0 END AS modified_s,
  CASE WHEN none OR k IN (3, 4) THEN '<xmp/>' END AS xmp FROM meta""",
    ),
    "rejected_patches": (
        rejected_patches,
        "SELECT doc_id, 'created-is-no-date' AS reason FROM documents WHERE doc_id % 6 = 3 AND doc_id % 9 <> 8",
    ),
    "strip_metadata": (
        strip_metadata,
        """SELECT doc_id, NULL::VARCHAR AS title, NULL::VARCHAR AS author, NULL::VARCHAR AS subject, NULL::VARCHAR AS creator, NULL::VARCHAR AS producer, NULL::VARCHAR AS keywords, NULL::VARCHAR AS xmp, 0 AS created_s, 0 AS modified_s FROM documents""",
    ),
    "keep_smaller": (
        keep_smaller,
        f"""WITH {_CAND} SELECT doc_id, method, before, after, round(saved, 9) AS saved,
  CASE WHEN NOT smaller THEN 'kept-original' WHEN saved < 0.01 THEN 'barely' ELSE 'smaller' END AS outcome FROM kept""",
    ),
    "size_delta": (size_delta, f"WITH {_CAND} SELECT doc_id, {_DELTA.format(a='after', b='before')} AS delta FROM kept"),
    "size_totals": (
        size_totals,
        f"""WITH {_CAND}, t AS (SELECT count(*) AS n_docs, sum(before)::BIGINT AS before, sum(after)::BIGINT AS after FROM kept)
SELECT n_docs, before, after, {_DELTA.format(a='after', b='before')} AS delta FROM t""",
    ),
    "flatten_estimate": (
        flatten_estimate,
        """WITH d AS (SELECT doc_id, n_chars // 20 AS n, CASE WHEN doc_id % 5 = 0 THEN 120 ELSE 36 + doc_id % 300 END AS dpi FROM documents),
p AS (SELECT *, CAST(floor(n * (8.5::DOUBLE * dpi * 11 * dpi) + 0.5) AS BIGINT) AS pixels FROM d)
SELECT doc_id, pixels, CAST(floor(pixels * 0.12::DOUBLE + n * 1024 + 0.5) AS BIGINT) AS rough_bytes, pixels > 100000000 OR n > 120 AS slow FROM p""",
    ),
    "rebuild_losses": (
        rebuild_losses,
        """WITH f AS (SELECT doc_id, n_chars AS c, doc_id AS d FROM documents),
l AS (SELECT doc_id, list_filter([CASE WHEN (d * 3 + c) % 2 = 0 THEN 'form fields' END, CASE WHEN (d * 5 + c) % 3 = 0 THEN 'bookmarks' END, CASE WHEN (d * 7 + c) % 4 = 0 THEN 'file attachments' END,
  CASE WHEN (d * 11 + c) % 5 = 0 THEN 'document scripts' END, CASE WHEN (d * 13 + c) % 3 = 0 OR (d * 17 + c) % 2 = 0 THEN 'named links' END, CASE WHEN (d * 19 + c) % 5 = 0 THEN 'accessibility tags' END,
  CASE WHEN (d * 23 + c) % 4 = 0 THEN 'layers' END, CASE WHEN (d * 29 + c) % 3 = 0 THEN 'page numbering' END], lambda x: x IS NOT NULL) AS w FROM f)
SELECT doc_id, array_to_string(w, ', ') AS losses, doc_id % 4 = 0 AS signed FROM l""",
    ),
    "traffic": (
        traffic,
        """WITH boot AS (SELECT user_id, min(ts) + INTERVAL 400 MILLISECONDS AS b FROM events GROUP BY user_id),
seen AS (SELECT e.user_id, ts, CAST(trunc(value * 100) AS BIGINT) AS bytes, CASE event_type WHEN 'click' THEN 'a' || (event_id % 5) || '.example.com' WHEN 'view' THEN 'b' || (event_id % 3) || '.example.org:8080'
    WHEN 'signup' THEN 'own' || (e.user_id % 2) END AS host FROM events e JOIN boot ON boot.user_id = e.user_id WHERE ts >= b AND event_type <> 'error'),
h AS (SELECT user_id, host, min(ts) AS f FROM seen WHERE host IS NOT NULL GROUP BY user_id, host),
hs AS (SELECT user_id, string_agg(host, ',' ORDER BY f, host) AS hosts FROM h GROUP BY user_id),
agg AS (SELECT user_id, count(*) AS n, sum(bytes)::BIGINT AS b FROM seen GROUP BY user_id),
up AS (SELECT user_id, sum(CAST(trunc(value) AS BIGINT))::BIGINT AS u FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT boot.user_id AS session, coalesce(n, 0) AS n_requests, coalesce(agg.b, 0) AS bytes_in, coalesce(u, 0) AS bytes_out, coalesce(hosts, '') AS hosts
FROM boot LEFT JOIN agg ON agg.user_id = boot.user_id LEFT JOIN up ON up.user_id = boot.user_id LEFT JOIN hs ON hs.user_id = boot.user_id""",
    ),
    "plan_export": (
        plan_export,
        f"""{fx.with_('page_boxes')}, s AS (
  SELECT doc_id, page_index, CASE WHEN (rotation + 720) % 180 = 90 THEN height ELSE width END * CASE WHEN doc_id % 9 = 0 THEN 10 ELSE 1 END AS vw,
    CASE WHEN (rotation + 720) % 180 = 90 THEN width ELSE height END AS vh, count(*) OVER (PARTITION BY doc_id) AS n, (20 + doc_id % 30 * 21)::DOUBLE AS dpi FROM page_boxes),
p AS (SELECT *, greatest(1, floor(vw * (dpi / 72)))::BIGINT AS w, greatest(1, floor(vh * (dpi / 72)))::BIGINT AS h FROM s WHERE (doc_id + page_index) % 2 = 0),
j AS (SELECT *, CASE WHEN dpi < 36 OR dpi > 600 THEN 'dpi-out-of-range' WHEN w * h > 50000000 THEN 'too-many-pixels' END AS reason FROM p)
SELECT doc_id, page_index, CASE WHEN reason IS NULL THEN 'a-' || doc_id || '-' || lpad((page_index + 1)::VARCHAR, CAST(length(n::VARCHAR) AS INT), '0') || '.' || CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'jpg' END END AS file_name,
  CASE WHEN reason IS NULL THEN w END AS width, CASE WHEN reason IS NULL THEN h END AS height, reason,
  CASE WHEN reason = 'too-many-pixels' THEN greatest(36, floor(dpi * sqrt(50000000 / (w * h))))::BIGINT END AS largest_dpi FROM j""",
    ),
}
