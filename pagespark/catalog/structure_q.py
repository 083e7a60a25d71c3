"""Page structure, page text, scores and language over the derived pages."""

from pyspark.sql import functions as F

from pagespark.catalog import greedy_sql
from pagespark.catalog.joins_q import CHOICE_SQL, MEET, READINGS_SQL, SAME, choices, readings
from pagespark.catalog.registry import query
from pagespark.catalog.support import LINE, PAGE, P, SIDES_SQL, area, big, envelope_aggs, inter, iou_1d, r6, total, v_iou
from pagespark.fixtures.sql import h, u, with_tables
from pagespark.fixtures.tables import SCRIPTS
from pagespark.functions.boxes import SIDES, Box, downscale_factor
from pagespark.functions.hashing import hash_pick
from pagespark.functions.scores import argmax_steps, contrast_stretch_array
from pagespark.functions.text import accepts_language, concat_ordered
from pagespark.operators import folds, scripts as SC
from pagespark.operators.aggregates import envelope
from pagespark.operators.chunks import split_windows
from pagespark.operators.joins import GROWING, looked_up
from pagespark.operators.lines import merge_fragments, merge_same_row
from pagespark.operators.order import reading_order
from pagespark.operators.suppress import link_lines, resolve_overlaps, suppress
from pagespark.plans import assemble, layout



# ---- lines -------------------------------------------------------------------------


def spread_words(t):
    """Words with a wide gap somewhere in most rows."""
    cut = hash_pick(12, "g", F.concat_ws("|", *LINE))
    dx = F.when(F.col("pos") % 12 >= cut, 30).otherwise(0)
    return t.words.select(*PAGE, "tag", "word", (F.col("left") + dx).alias("left"), "top", (F.col("right") + dx).alias("right"), "bottom")


@query("p1_link_lines", with_tables(f"""
  SELECT {P}, min(l) AS "left", min(t) AS "top", max(r) AS "right", max(b) AS "bottom", count(*) AS n,
    string_agg(word, ' ' ORDER BY l) AS text
  FROM (SELECT *, sum(starts) OVER (PARTITION BY {P}, row_no ORDER BY l) AS island FROM (
    SELECT *, CASE WHEN l - lag(r) OVER (PARTITION BY {P}, row_no ORDER BY l) - 1 <= 20 THEN 0 ELSE 1 END AS starts FROM moved))
  GROUP BY {P}, row_no, island""", "words", extra=f"""
  moved AS MATERIALIZED (SELECT {P}, row_no, word, l+dx AS l, t, r+dx AS r, b FROM (SELECT *, CASE WHEN pos % 12 >=
    {h("concat('g|',doc_id,'|',page_no,'|',row_no)")} % 12 THEN 30 ELSE 0 END AS dx FROM words))"""))
def p1(t):
    """The oracle uses that rows of the derived pages never touch."""
    return link_lines(spread_words(t), PAGE).groupBy(*PAGE, "line").agg(*envelope_aggs(), F.count("*").alias("n"),
                                            concat_ordered([F.col("left")], F.col("word"), " ").alias("text")).drop("line")


_SUB_FITS = "list_any"


@query("p2_split_sublines", with_tables(f"""
  SELECT {P}, row_no, len(subs) AS sublines, list_sum(list_transform(subs, lambda s: len(s)))::bigint AS members,
    list_sum(list_transform(subs, lambda s: list_min(s)*len(s)))::bigint AS tops
  FROM walk WHERE i = n""", "words", recursive=True, extra=f"""
  tops AS MATERIALIZED (SELECT {P}, row_no, list(t ORDER BY l, tag) AS ts, count(*) AS n FROM words GROUP BY ALL),
  walk AS (SELECT {P}, row_no, ts, n, 1::bigint AS i, [[ts[1]]] AS subs FROM tops
    UNION ALL SELECT {P}, row_no, ts, n, i+1, CASE WHEN len(list_filter(subs, lambda s: len(list_filter(s, lambda y: (14-abs(y-ts[i+1]))/(14.0::double+abs(y-ts[i+1])) > 0.7)) > 0)) > 0
      THEN list_transform(subs, lambda s: CASE WHEN len(list_filter(s, lambda y: (14-abs(y-ts[i+1]))/(14.0::double+abs(y-ts[i+1])) > 0.7)) > 0 THEN list_append(s, ts[i+1]) ELSE s END)
      ELSE list_append(subs, [ts[i+1]]) END FROM walk WHERE i < n)"""))
def p2(t):
    """The oracle uses that all words are 14 pixels high."""
    subs = folds.split_sublines(t.words, LINE)
    per = subs.groupBy(*LINE, "subline").agg(F.count("*").alias("n"), F.min("top").alias("top"))
    return per.groupBy(*LINE).agg(F.count("*").alias("sublines"), total("n").alias("members"), total(F.col("top") * F.col("n")).alias("tops"))


def _sublines(t, threshold=0.7):
    boxes = t.detections.withColumn("tag", F.concat_ws("|", "tag", "k"))
    subs = folds.split_sublines(boxes, LINE, threshold=threshold)
    return subs.withColumn("line", F.col("row_no") * 100 + F.col("subline")).withColumn("tag", F.concat_ws("/", "tag", "subline"))


@query("p2_split_sublines_loose", with_tables(greedy_sql.LOOSE_LINES_BODY, "detections", recursive=True, extra=greedy_sql.sublines_sql(0.1)))
def p2_loose(t):
    """Sub-lines with the low threshold, over doubled detections."""
    return _sublines(t, 0.1).groupBy(*LINE, "subline").agg(*envelope_aggs(), F.count("*").alias("n"))


_ABSORBED = greedy_sql.absorb_sql()


@query("p3_absorb_lines", with_tables(_ABSORBED[0], "detections", recursive=True, extra=_ABSORBED[1]))
def p3(t):
    kept = folds.absorb_lines(_sublines(t), PAGE, "line")
    return kept.groupBy(*PAGE, "new_line").agg(*envelope_aggs(), F.count("*").alias("n"))


@query("p4_suppress", with_tables(greedy_sql.SUPPRESS_BODY, "detections", recursive=True, extra=greedy_sql.SUPPRESS_SQL))
def p4(t):
    """The oracle uses that boxes of different rows never meet by half."""
    boxes = t.detections.select(*PAGE, F.concat_ws("|", "tag", "k").alias("key"), *SIDES)
    left = suppress(boxes, PAGE, "key", ["size_based_nms", "area_threshold", "length_threshold"],
                    {"intersection_thr": 0.5, "area_threshold": 300, "length_threshold": 5})
    return left.groupBy(*PAGE).agg(F.count("*").alias("n"), total("left").alias("s_left"), total(Box.of().area).alias("area"))


@query("p4_suppress_doubles", with_tables(f"""
  SELECT {P}, count(*) AS n, sum(l)::bigint AS s_left FROM detections d
  WHERE NOT (k = 0 AND EXISTS (SELECT 1 FROM detections o WHERE o.tag = d.tag AND o.k = 1)) GROUP BY ALL""", "detections"))
def p4_doubles(t):
    """Of a word and its larger double the double stays; no two words meet by half."""
    boxes = t.detections.select(*PAGE, F.concat_ws("|", "tag", "k").alias("key"), *SIDES)
    left = suppress(boxes, PAGE, "key", ["size_based_nms"], {"intersection_thr": 0.5})
    return left.groupBy(*PAGE).agg(F.count("*").alias("n"), total("left").alias("s_left"))


_ROWS_SQL = f"""joined AS MATERIALIZED (SELECT *, sum(starts) OVER (PARTITION BY {P}, par ORDER BY t, line_id) AS grp,
    row_number() OVER (PARTITION BY {P}, par ORDER BY t, line_id) AS nth FROM (
    SELECT *, CASE WHEN {iou_1d('lag(t) OVER w', 'lag(b) OVER w', 't', 'b')} >= 0.8 THEN 0 ELSE 1 END AS starts
    FROM placed WHERE par IS NOT NULL WINDOW w AS (PARTITION BY {P}, par ORDER BY t, line_id))),
  merged AS MATERIALIZED (SELECT {P}, par, grp, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, string_agg(text, ' ' ORDER BY l, nth) AS text
    FROM joined GROUP BY ALL)"""
_PLACED_SQL = f"""placed AS MATERIALIZED (SELECT a.*, (SELECT min(o.par) FROM paragraphs o WHERE {SAME} AND {inter('a.', 'o.')} >= 0.8::double * {area('a.')}) AS par FROM lines a)"""


@query("w3_merge_same_row", with_tables(f"SELECT {P}, {SIDES_SQL}, text FROM merged", "lines", extra="placed AS MATERIALIZED (SELECT *, 0 AS par FROM lines),\n" + _ROWS_SQL))
def w3(t):
    return merge_same_row(t.lines, PAGE).drop("row_group")


@query("p11_paragraph_text", with_tables(f"""
  SELECT {P}, string_agg(text, chr(10) ORDER BY kind, nth) AS text FROM (
    SELECT {P}, 0 AS kind, par AS nth, string_agg(text, ' ' ORDER BY t, grp) AS text FROM merged GROUP BY {P}, par
    UNION ALL SELECT {P}, 1, line_id, text FROM placed WHERE par IS NULL) GROUP BY {P}""", "lines", "paragraphs", extra=_PLACED_SQL + ",\n" + _ROWS_SQL))
def p11(t):
    return assemble.paragraph_text(t.lines, t.paragraphs, PAGE)


@query("p12_merge_fragments", with_tables(f"""
  SELECT max(tag) AS tag, string_agg(word, '' ORDER BY tag) AS word, min(l) AS "left", min(t) AS "top", max(r) AS "right", max(b) AS "bottom",
    count(*) > 1 AS changed FROM fragments GROUP BY source""", "fragments"))
def p12(t):
    """In the derived pages the only touching pieces are those of one word."""
    merged = merge_fragments(t.fragments.select(*PAGE, "tag", "word", *SIDES), PAGE)
    return merged.select("tag", "word", *SIDES, "changed")


# ---- layout ------------------------------------------------------------------------


def layout_words(t):
    return t.two_col.withColumnRenamed("word", "text").withColumnRenamed("row_no", "line")


def layout_lines(t):
    return layout_words(t).groupBy(*PAGE, "line").agg(*envelope_aggs(), concat_ordered([F.col("left"), F.col("tag")], F.col("text"), " ").alias("text"))


@query("p5_x_clusters", with_tables(f"""
  SELECT {P}, len(cs) AS clusters, cs[1].n AS first_size, list_sum(list_transform(range(1, len(cs)+1), lambda k: k*cs[k].n))::bigint AS weight FROM walk WHERE i = n""",
  "two_col", recursive=True, extra=f"""
  ln AS MATERIALIZED (SELECT {P}, row_no, min(l)::double AS l, max(r)::double AS r FROM two_col GROUP BY ALL),
  pg AS MATERIALIZED (SELECT {P}, list({{'l': l, 'r': r}} ORDER BY row_no) AS ls, count(*) AS n FROM ln GROUP BY ALL),
  walk AS (SELECT {P}, ls, n, 1::bigint AS i, [{{'l': ls[1].l, 'r': ls[1].r, 'n': 1::bigint}}] AS cs FROM pg
    UNION ALL SELECT {P}, ls, n, i+1, CASE WHEN hit = 0 THEN list_append(cs, {{'l': ls[i+1].l, 'r': ls[i+1].r, 'n': 1::bigint}})
      ELSE list_transform(cs, lambda c, k: CASE WHEN k = hit THEN {{'l': c.l+ls[i+1].l, 'r': c.r+ls[i+1].r, 'n': c.n+1}} ELSE c END) END
    FROM (SELECT *, coalesce(list_position(list_transform(cs, lambda c: abs(c.l/c.n - ls[i+1].l) < 15 OR abs(c.r/c.n - ls[i+1].r) < 15), true), 0) AS hit
      FROM walk WHERE i < n))"""))
def p5(t):
    found = folds.x_clusters(layout_lines(t), PAGE, "line")
    sizes = found.groupBy(*PAGE, "cluster").agg(F.count("*").alias("n"))
    return sizes.groupBy(*PAGE).agg(F.count("*").alias("clusters"), F.min_by("n", "cluster").alias("first_size"),
                                    total((F.col("cluster") + 1) * F.col("n")).alias("weight"))


@query("p6_paragraph_boxes", with_tables(greedy_sql.COLUMNS_BODY, "two_col", recursive=True, extra=greedy_sql.COLUMNS_SQL))
def p6(t):
    return folds.column_boxes(layout_lines(t), PAGE, "line")


def _headers(t, compat):
    return layout.headers_footers(layout_lines(t), None, PAGE, "line", compat).select(*PAGE, "line", "par", "role", "moved")


@query("p7_headers_footers", with_tables(greedy_sql.HEADERS_BODY, "two_col", recursive=True, extra=greedy_sql.headers_sql(False)))
def p7(t):
    return _headers(t, False)


@query("p7_headers_footers_compat", with_tables(greedy_sql.HEADERS_BODY, "two_col", recursive=True, extra=greedy_sql.headers_sql(True)))
def p7_compat(t):
    return _headers(t, True)


@query("p8_rerow_words", with_tables(f"""
  SELECT {P}, len(rs) AS rows, list_sum(list_transform(range(1, len(rs)+1), lambda k: k*rs[k].n))::bigint AS weight FROM walk WHERE i = n""",
  "words", recursive=True, extra=f"""
  pg AS MATERIALIZED (SELECT {P}, row_no//5 AS par, list({{'t': t, 'b': b}} ORDER BY l, tag) AS ws, count(*) AS n FROM words GROUP BY ALL),
  walk AS (SELECT {P}, par, ws, n, 1::bigint AS i, [{{'t': ws[1].t::double, 'b': ws[1].b::double, 'n': 1::bigint}}] AS rs FROM pg
    UNION ALL SELECT {P}, par, ws, n, i+1, CASE WHEN hit = 0 THEN list_append(rs, {{'t': ws[i+1].t::double, 'b': ws[i+1].b::double, 'n': 1::bigint}})
      ELSE list_transform(rs, lambda c, k: CASE WHEN k = hit THEN {{'t': c.t+ws[i+1].t, 'b': c.b+ws[i+1].b, 'n': c.n+1}} ELSE c END) END
    FROM (SELECT *, coalesce(list_position(list_transform(rs, lambda c: greatest(0, least(c.b/c.n, ws[i+1].b) - greatest(c.t/c.n, ws[i+1].t) + 1) >= 0.5*(ws[i+1].b-ws[i+1].t)), true), 0) AS hit
      FROM walk WHERE i < n))""").replace(f"SELECT {P}, len(rs)", f"SELECT {P}, par, len(rs)"))
def p8(t):
    par = big(F.floor(F.col("row_no") / 5)).alias("par")
    rows = folds.rerow_words(t.words.select(*PAGE, par, "tag", *SIDES), [*PAGE, "par"], ["tag"])
    sizes = rows.groupBy(*PAGE, "par", "new_row").agg(F.count("*").alias("n"))
    return sizes.groupBy(*PAGE, "par").agg(F.count("*").alias("rows"), total((F.col("new_row") + 1) * F.col("n")).alias("weight"))


@query("p9_reading_bands", with_tables(f"""
  SELECT {P}, par, band, row_number() OVER (PARTITION BY {P} ORDER BY band, l, t, par) - 1 AS rank FROM walk""",
  "two_col", recursive=True, extra=f"""
  ps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {P} ORDER BY t, par) AS i FROM (
    SELECT {P}, row_no//5 AS par, min(l) AS l, min(t) AS t, max(b) AS b FROM two_col GROUP BY ALL)),
  walk AS (SELECT {P}, par, l, t, i, b AS head, 0::bigint AS band FROM ps WHERE i = 1
    UNION ALL SELECT p.doc_id, p.page_no, p.par, p.l, p.t, p.i, CASE WHEN p.t > w.head THEN p.b ELSE w.head END, w.band + (p.t > w.head)::bigint
    FROM walk w JOIN ps p ON p.doc_id = w.doc_id AND p.page_no = w.page_no AND p.i = w.i + 1)"""))
def p9(t):
    par = big(F.floor(F.col("row_no") / 5))
    boxes = envelope(t.two_col.withColumn("par", par), [*PAGE, "par"])
    return folds.reading_bands(boxes, PAGE, "par", ["par"]).select(*PAGE, "par", "band", "rank")


@query("p10_extract_layout", with_tables(f"SELECT {P}, string_agg(text, chr(10) ORDER BY rank) AS text FROM blocks GROUP BY {P}", "two_col", recursive=True, extra=greedy_sql.blocks_sql()))
def p10(t):
    return layout.extract_layout(layout_lines(t), layout_words(t), PAGE, "line")


@query("p10_layout_blocks", with_tables("SELECT * FROM blocks", "two_col", recursive=True, extra=greedy_sql.blocks_sql()))
def p10_blocks(t):
    return layout.extract_layout(layout_lines(t), layout_words(t), PAGE, "line", as_text=False)


def run_words(t):
    """Words in reading order with paragraphs of five rows, some words strayed one back."""
    strayed = F.when((hash_pick(40, "W", F.col("tag")) == 0) & (F.col("row_no") >= 5), 1).otherwise(0)
    words = reading_order(t.words.select(*PAGE, "row_no", "tag", *SIDES), PAGE, ["row_no", "left", "tag"], "place")
    return words.withColumn("paragraph", big(F.floor(F.col("row_no") / 5)) - strayed)


RUNS_SQL = f"""rw AS MATERIALIZED (SELECT *, max(place) OVER (PARTITION BY {P}, paragraph) AS last FROM (SELECT {P}, l, t, r, b, row_number() OVER (PARTITION BY {P} ORDER BY row_no, l, tag) - 1 AS place,
    row_no//5 - CASE WHEN row_no >= 5 AND {h("concat('W|',tag)")} % 40 = 0 THEN 1 ELSE 0 END AS paragraph FROM words)),
  starts AS (SELECT {P}, place AS s, last AS e FROM rw WHERE place = 0
    UNION ALL SELECT rw.doc_id, rw.page_no, rw.place, rw.last FROM starts x JOIN rw ON rw.doc_id = x.doc_id AND rw.page_no = x.page_no AND rw.place = x.e + 1)"""


@query("w4_paragraph_runs", with_tables(f"""
  SELECT {P}, s AS run, count(*) AS n FROM starts JOIN rw USING (doc_id, page_no) WHERE place BETWEEN s AND e GROUP BY ALL""", "words", recursive=True, extra=RUNS_SQL))
def w4(t):
    return folds.paragraph_runs(run_words(t), PAGE, "place", "paragraph").groupBy(*PAGE, "run").agg(F.count("*").alias("n"))


def loose_paragraphs(t):
    """Words in paragraphs of which some reach into others."""
    return t.two_col.withColumn("par", big(F.floor(F.col("row_no") / 5))).withColumn(
        "par", F.when(hash_pick(30, "L", F.concat_ws("|", *LINE)) == 0, F.col("par") + 20).otherwise(F.col("par")))


_RESOLVED = {compat: greedy_sql.resolve_sql(compat) for compat in (False, True)}


@query("p13_resolve_overlaps", with_tables(_RESOLVED[False][0], "two_col", recursive=True, extra=_RESOLVED[False][1]))
def p13(t):
    kept = resolve_overlaps(loose_paragraphs(t).withColumnRenamed("par", "source"), PAGE, "source", "tag")
    return kept.groupBy(*PAGE, "par").agg(*envelope_aggs(), F.count("*").alias("n"))


@query("p13_resolve_overlaps_compat", with_tables(_RESOLVED[True][0], "two_col", recursive=True, extra=_RESOLVED[True][1]))
def p13_compat(t):
    kept = resolve_overlaps(loose_paragraphs(t).withColumnRenamed("par", "source"), PAGE, "source", "tag", compat=True)
    return kept.groupBy(*PAGE, "par").agg(*envelope_aggs(), F.count("*").alias("n"))


_LABELLED = greedy_sql.label_sql(f"SELECT {P}, s AS run, place AS ord, l, t, r, b FROM starts JOIN rw USING (doc_id, page_no) WHERE place BETWEEN s AND e")


@query("p14_label_layout", with_tables(_LABELLED[0], "words", recursive=True, extra=RUNS_SQL + ",\n" + _LABELLED[1]))
def p14(t):
    return layout.label_layout(run_words(t), PAGE, "place", "paragraph")


# ---- page text and wide words --------------------------------------------------------


@query("t1_page_text", with_tables(f"""
  SELECT {P}, string_agg(text, chr(10) ORDER BY (t+b)/2.0, line_id) AS text FROM lines GROUP BY ALL""", "lines"))
def t1(t):
    return assemble.page_text(t.lines, PAGE, "line_id")


@query("t7_box_orders", with_tables(f"""
  SELECT {P}, string_agg(tag, ',' ORDER BY l, tag) AS by_left, string_agg(tag, ',' ORDER BY {area()} DESC, tag) AS by_area FROM images GROUP BY ALL""", "images"))
def t7(t):
    return t.images.groupBy(*PAGE).agg(
        concat_ordered([F.col("left"), F.col("tag")], F.col("tag"), ",").alias("by_left"),
        concat_ordered([-Box.of().area, F.col("tag")], F.col("tag"), ",").alias("by_area"))


@query("t2_argmax_first", with_tables("""
  SELECT tag, arg_max(script, score*1000 - list_position(['latin','german','french','spanish'], script)) AS script FROM script_scores GROUP BY tag""", "script_scores"))
def t2(t):
    return SC.argmax_first(t.script_scores, ["tag"], SCRIPTS)


@query("t3_first_by_priority", with_tables("""
  SELECT tag, arg_min(script, list_position(['spanish','german','latin'], script)) AS script FROM script_scores
  WHERE score > 0.5::double AND script IN ('spanish','german','latin') GROUP BY tag""", "script_scores"))
def t3(t):
    return SC.decide_script(t.script_scores, ["tag"], "priority", ("spanish", "german", "latin"))


@query("p15_assemble_pages", with_tables(f"""
  SELECT {P}, count(*) AS n_lines, sum(n)::bigint AS n_words, string_agg(text, chr(10) ORDER BY (t+b)/2.0, row_no) AS text FROM (
    SELECT {P}, row_no, count(*) AS n, min(t) AS t, max(b) AS b, string_agg(text, ' ' ORDER BY l, tag) AS text FROM (
      SELECT w.doc_id, w.page_no, w.row_no, w.tag, (w.l//f)*f AS l, (w.t//f)*f AS t, ((w.l+10*length(w.word)-9)//f)*f AS r, (w.b//f)*f AS b, x.text
      FROM words w JOIN scaled USING (doc_id, page_no) LEFT JOIN (SELECT r.tag, r.text FROM readings r JOIN choice c ON c.tag = r.tag AND c.script = r.recogniser) x ON x.tag = w.tag)
    WHERE l < r AND t < b GROUP BY ALL) GROUP BY {P}""", "words", "page_dims", "recognised", extra=READINGS_SQL + ", " + CHOICE_SQL + f""",
  scaled AS MATERIALIZED (SELECT {P}, (1 << list_filter(range(0,21), lambda k: (greatest(scale_w,scale_h) >> k) < 2000)[1])::bigint AS f FROM page_dims)"""))
def p15(t):
    """The flagship: words found on the downscaled page, readings and scripts joined, page text."""
    dims = t.page_dims
    f = downscale_factor(F.col("scale_w"), F.col("scale_h"), 2000)
    down = lambda c: F.floor(c / F.col("_f")).cast("bigint")
    right = F.col("left") + 10 * F.length("word") - 9
    words = looked_up(t.words, dims.select(*PAGE, f.alias("_f")), PAGE).select(
        *PAGE, "row_no", "tag", down(F.col("left")).alias("left"), down(F.col("top")).alias("top"),
        down(right).alias("right"), down(F.col("bottom")).alias("bottom"))
    return assemble.assemble_pages(dims, words, readings(t), choices(t), PAGE, "row_no")


@query("p16_decode_wide", with_tables(f"""
  SELECT tag, string_agg(list_reduce(list_prepend('', list_transform(list_filter(range(1, len(cls)+1), lambda i: i = 1 OR cls[i] <> cls[i-1]),
      lambda i: CASE WHEN cls[i] = n + 1 THEN '' ELSE substr(cs, cls[i]::bigint, 1) END)), lambda x, y: concat(x, y)), '' ORDER BY chunk) AS text FROM charset, (
    SELECT tag, chunk, list_transform(list_slice(scores, chunk*k+1, chunk*k+k), lambda s: list_position(s, list_max(s))) AS cls FROM (
      SELECT tag, scores, unnest(range(0, m)) AS chunk, m, ceil(len(scores)/m::double)::bigint AS k FROM (
        SELECT c.tag, c.scores, CASE WHEN w > 150 AND w/h::double >= 8 THEN (w-1)//150 + 1 ELSE 1 END AS m FROM char_scores c JOIN wide_words USING (tag)))) GROUP BY tag""", "char_scores", "wide_words", "charset"))
def p16(t):
    """Wide words cut in windows; each window holds its share of the word's score steps."""
    read = t.char_scores.select(*PAGE, "tag", argmax_steps(F.col("scores")).alias("classes"))  # scores stay in their task
    sized = looked_up(read, t.wide_words.select(*PAGE, "tag", "w", "h"), [*PAGE, "tag"])
    scored = split_windows(sized, F.col("w"), F.col("h"))
    m = F.when((F.col("w") > 150) & (F.col("w") / F.col("h") >= 8), F.floor((F.col("w") - 1) / 150) + 1).otherwise(1)
    k = F.ceil(F.size("classes") / m).cast("int")
    share = F.slice("classes", (F.col("chunk") * k + 1).cast("int"), k)
    return assemble.decode_wide(scored.select(*PAGE, "tag", "chunk", share.alias("classes")), [*PAGE, "tag"], t.charset, classes="classes").drop(*PAGE)


# ---- scores and languages --------------------------------------------------------------

WEIGHTS = {name: ([round(((i * 7 + j * 5) % 11 - 5) / 10, 1) for i in range(8)], round((j - 1) / 10, 1)) for j, name in enumerate(SCRIPTS)}


def _script_sql() -> str:
    rows = []
    for name, (ws, bias) in WEIGHTS.items():
        dot = "+".join(f"({w}::double)*m[{i + 1}]" for i, w in enumerate(ws))
        rows.append(f"SELECT vec_id, '{name}' AS script, 1/(1+exp(-({dot}+({bias}::double)))) AS s FROM m")
    return ("WITH m AS (SELECT vec_id, list_transform(range(1,9), lambda j: list_sum(list_transform(range(0,8), lambda k: embedding[(k*8+j)::bigint]::double))/8) AS m FROM embeddings) "
            "SELECT vec_id, script, round(s,6) AS score, (s > 0.5)::bigint AS flag FROM (" + " UNION ALL ".join(rows) + ")")


@query("x5_script_scores", _script_sql())
def x5(t):
    vectors = t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return SC.script_scores(vectors, "v", WEIGHTS, steps=8).select("vec_id", "script", r6(F.col("score")).alias("score"), "flag")


_LL_SQL = """grams AS MATERIALIZED (SELECT doc_id, lang, gram, count(*) AS n FROM (SELECT doc_id, lang, unnest(list_transform(range(1, length(text)), lambda i: substr(text, i, 2))) AS gram FROM documents) GROUP BY ALL),
  model AS MATERIALIZED (SELECT lang, gram, sum(n)::bigint AS m FROM grams GROUP BY ALL),
  totals AS MATERIALIZED (SELECT lang, sum(m)::bigint AS total, (SELECT count(DISTINCT gram) FROM model) AS v FROM model GROUP BY lang),
  ll AS MATERIALIZED (SELECT doc_id, t.lang, coalesce(known,0) - length * ln(total + v) AS ll FROM (SELECT doc_id, sum(n)::bigint AS length FROM grams GROUP BY doc_id), totals t
    LEFT JOIN (SELECT doc_id AS d, m.lang AS g, sum(n*ln(m+1.0::double)) AS known FROM grams JOIN model m USING (gram) GROUP BY ALL) ON d = doc_id AND g = t.lang),
  probs AS MATERIALIZED (SELECT doc_id, lang, exp(ll - mx)/sum(exp(ll - mx)) OVER (PARTITION BY doc_id) AS prob FROM (SELECT *, max(ll) OVER (PARTITION BY doc_id) AS mx FROM ll))"""


def _language_scores(t):
    docs = t.documents.select("doc_id", "lang", "text")
    return SC.text_language_scores(docs, "doc_id", SC.bigram_model(docs))


@query("x6_language_scores", with_tables("SELECT doc_id, lang, round(prob,6) AS prob FROM probs", extra=_LL_SQL))
def x6(t):
    rows = _language_scores(t).select("doc_id", F.explode("scores").alias("s"))
    return rows.select("doc_id", "s.lang", r6(F.col("s.prob")).alias("prob"))


@query("f3_accepts_language", with_tables("SELECT doc_id FROM probs WHERE lang = 'de' AND prob >= 0.5", extra=_LL_SQL))
def f3(t):
    return _language_scores(t).filter(accepts_language(F.col("scores"), "de")).select("doc_id")


@query("x7_contrast_stretch", """
  SELECT vec_id, pos, round((v-lo)/greatest(hi-lo,1.0)*255.0,6) AS value FROM (SELECT *, min(v) OVER (PARTITION BY vec_id, c) AS lo, max(v) OVER (PARTITION BY vec_id, c) AS hi FROM (
    SELECT vec_id, pos, pos // 16 AS c, v FROM (SELECT vec_id, unnest(embedding)::double AS v, generate_subscripts(embedding,1)-1 AS pos FROM embeddings)))""")
def x7(t):
    rows = t.read("embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value"))
    rows = rows.withColumn("pos", big(F.col("pos"))).withColumn("channel", F.floor(F.col("pos") / 16))
    return SC.contrast_stretch(rows, ["vec_id", "channel"], "value").select("vec_id", "pos", r6(F.col("value")).alias("value"))


@query("x7_contrast_stretch_array", """
  SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: (v::double-list_min(embedding)::double)/greatest(list_max(embedding)::double-list_min(embedding)::double,1.0)*255.0)),4) AS value FROM embeddings""")
def x7_array(t):
    v = contrast_stretch_array(F.col("embedding").cast("array<double>"))
    return t.read("embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("value"))
