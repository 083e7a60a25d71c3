"""Box geometry over the words, detections and pages (G1-G11, F9-F11)."""

from pyspark.sql import functions as F

from pagespark.catalog.registry import query
from pagespark.catalog.support import PAGE, P, area, big, iou_1d, inter, r6, total, v_iou
from pagespark.fixtures.sql import with_tables
from pagespark.functions import boxes as B
from pagespark.functions.boxes import Box
from pagespark.operators.chunks import split_windows
from pagespark.operators.joins import GROWING, sent_if_few
from pagespark.session import written

# A mild homography for the warp query.
MATRIX = ((0.98, 0.04, 3.5), (-0.02, 1.01, 7.25), (0.00001, 0.00002, 1.0))


def _pairs(t):
    """Each word with every image of its page: plain pairs for column functions, bounded by a page's images."""
    images = t.images.select(*PAGE, *Box.of().columns("o_"))
    return t.words.hint("merge").join(images.hint("merge"), list(PAGE))


PAIRS_SQL = """(SELECT w.*, i.l AS ol, i.t AS ot, i.r AS ore, i.b AS ob FROM words w JOIN images i
  ON w.doc_id = i.doc_id AND w.page_no = i.page_no)"""


@query("g1_box_forms", with_tables(
    f"SELECT {P}, sum(l)::bigint AS s_left, sum(t)::bigint AS s_top, sum(r)::bigint AS s_right, sum(b)::bigint AS s_bottom FROM words GROUP BY ALL", "words"))
def g1(t):
    """Boxes through struct and array form and back."""
    nested = t.words.select(*PAGE, Box.of().array().alias("arr"))
    back = nested.select(*PAGE, Box.from_array(F.col("arr")).struct().alias("box"))
    box = Box.from_struct(F.col("box"))
    return back.groupBy(*PAGE).agg(*[total(c).alias("s_" + s) for c, s in zip(box.sides, B.SIDES)])


@query("g2_span_iou", with_tables(f"""
  SELECT {P}, round(sum({iou_1d('t', 'b', 'ot', 'ob')}),6) AS v_iou, round(sum({iou_1d('l', 'r', 'ol', 'ore')}),6) AS h_iou,
    sum(greatest(0, least(b,ob)-greatest(t,ot)+1))::bigint AS v_overlap,
    sum(CASE WHEN least(b,ob) >= greatest(t,ot) THEN greatest(b,ob)-least(t,ot)+1 ELSE b-t+1+ob-ot+1 END)::bigint AS v_union
  FROM {PAIRS_SQL} GROUP BY ALL""", "words", "images"))
def g2(t):
    a, b = Box.of(), Box.of("o_")
    return _pairs(t).groupBy(*PAGE).agg(
        r6(F.sum(B.v_iou(a, b))).alias("v_iou"), r6(F.sum(B.h_iou(a, b))).alias("h_iou"),
        total(B.overlap_1d(a.top, a.bottom, b.top, b.bottom)).alias("v_overlap"),
        total(B.union_1d(a.top, a.bottom, b.top, b.bottom)).alias("v_union"))


@query("g3_areas", with_tables(f"""
  SELECT {P}, sum({area()})::bigint AS area, sum(ia)::bigint AS inter_area,
         round(sum(ia::double / ({area()} + oa - ia)::double),6) AS iou
  FROM (SELECT *, greatest(0, least(r,ore)-greatest(l,ol)+1)*greatest(0, least(b,ob)-greatest(t,ot)+1) AS ia,
               (ore-ol+1)*(ob-ot+1) AS oa FROM {PAIRS_SQL}) GROUP BY ALL""", "words", "images"))
def g3(t):
    a, b = Box.of(), Box.of("o_")
    return _pairs(t).groupBy(*PAGE).agg(
        total(a.area).alias("area"), total(B.inter_area(a, b)).alias("inter_area"), r6(F.sum(B.iou(a, b))).alias("iou"))


@query("g4_box_minus", with_tables(f"""
  SELECT {P}, sum(ml)::bigint AS s_left, sum(mt)::bigint AS s_top,
    sum(CASE WHEN ml = ore+1 THEN r ELSE ol-1 END)::bigint AS s_right,
    sum(CASE WHEN mt = ob+1 THEN b ELSE ot-1 END)::bigint AS s_bottom
  FROM (SELECT *, CASE WHEN ol > l THEN l ELSE ore+1 END AS ml, CASE WHEN ot > t THEN t ELSE ob+1 END AS mt FROM {PAIRS_SQL})
  GROUP BY ALL""", "words", "images"))
def g4(t):
    rest = B.box_minus(Box.of(), Box.of("o_"))
    return _pairs(t).groupBy(*PAGE).agg(*[total(c).alias("s_" + s) for c, s in zip(rest.sides, B.SIDES)])


@query("g5_pad_clip", with_tables(f"""
  SELECT {P}, sum(greatest(l-7,0))::bigint AS s_left, sum(greatest(t-7,0))::bigint AS s_top,
    sum(least(r+7,w-1))::bigint AS s_right, sum(least(b+7,h-1))::bigint AS s_bottom
  FROM words JOIN page_dims USING (doc_id, page_no) GROUP BY ALL""", "words", "page_dims"))
def g5(t):
    padded = B.pad_clip(Box.of(), 7, F.col("w"), F.col("h"))
    return t.words.join(t.page_dims.hint(GROWING), list(PAGE)).groupBy(*PAGE).agg(
        *[total(c).alias("s_" + s) for c, s in zip(padded.sides, B.SIDES)])


@query("g6_downscale", with_tables(f"""
  SELECT {P}, scale_w, scale_h, (1 << list_filter(range(0,21), lambda k: (greatest(scale_w,scale_h) >> k) < 2000)[1])::bigint AS factor
  FROM page_dims""", "page_dims"))
def g6(t):
    return t.page_dims.select(*PAGE, "scale_w", "scale_h",
                              B.downscale_factor(F.col("scale_w"), F.col("scale_h"), 2000).alias("factor"))


def _warp_sql() -> str:
    def px(x, y, row):
        a, b, c = MATRIX[row]
        return f"({a}::double*{x}+{b}::double*{y}+{c}::double)"

    xs = ", ".join(f"{px(x, y, 0)}/{px(x, y, 2)}" for x in "lr" for y in "tb")
    ys = ", ".join(f"{px(x, y, 1)}/{px(x, y, 2)}" for x in "lr" for y in "tb")
    return f"""SELECT {P}, sum(trunc(greatest(least({xs}),0)))::bigint AS s_left, sum(trunc(greatest(least({ys}),0)))::bigint AS s_top,
      sum(trunc(least(greatest({xs}),w-1)))::bigint AS s_right, sum(trunc(least(greatest({ys}),h-1)))::bigint AS s_bottom
      FROM words JOIN page_dims USING (doc_id, page_no) GROUP BY ALL"""


@query("g7_warp_box", with_tables(_warp_sql(), "words", "page_dims"))
def g7(t):
    box = B.warp_box(Box.of(), MATRIX, F.col("w"), F.col("h"))
    return t.words.join(t.page_dims.hint(GROWING), list(PAGE)).groupBy(*PAGE).agg(
        *[total(c).alias("s_" + s) for c, s in zip(box.sides, B.SIDES)])


def _resize_sql() -> str:
    """Each method as its own steps: shrink to the height, shrink to the width, grow."""
    grow_h = "CASE WHEN {h} < 48 AND {w} < 150 THEN CASE WHEN {h}/48.0::double > {w}/150.0::double THEN 48 ELSE least(greatest(trunc(150.0::double/{w}*{h}),1),48) END ELSE {h} END"
    grow_w = "CASE WHEN {h} < 48 AND {w} < 150 THEN CASE WHEN {h}/48.0::double > {w}/150.0::double THEN least(greatest(trunc(48.0::double/{h}*{w}),1),150) ELSE 150 END ELSE {w} END"
    fit_w = "greatest(trunc(48.0::double/h*w),1)"
    out = []
    out.append("SELECT w, h, 'without_ar' AS method, 48 AS nh, 150 AS nw FROM d")
    a1 = f"(SELECT w AS w0, h AS h0, CASE WHEN h>48 THEN 48 ELSE h END AS h1, CASE WHEN h>48 THEN {fit_w} ELSE w END AS w1 FROM d)"
    a2 = f"(SELECT w0, h0, CASE WHEN w1>150 THEN greatest(trunc(150.0::double/w1*h1),1) ELSE h1 END AS h2, CASE WHEN w1>150 THEN 150 ELSE w1 END AS w2 FROM {a1})"
    out.append(f"SELECT w0, h0, 'ar', {grow_h.format(h='h2', w='w2')}, {grow_w.format(h='h2', w='w2')} FROM {a2}")
    c1 = f"(SELECT w, h, {grow_h.format(h='h', w='w')} AS h1, {grow_w.format(h='h', w='w')} AS w1 FROM d)"
    out.append(f"SELECT w, h, 'comb', CASE WHEN h1>48 OR w1>150 THEN 48 ELSE h1 END, CASE WHEN h1>48 OR w1>150 THEN 150 ELSE w1 END FROM {c1}")
    out.append(f"SELECT w, h, 'dynamic_w', 48, {fit_w} FROM d")
    out.append(f"SELECT w, h, 'ar_clip_w', CASE WHEN h>48 THEN 48 ELSE h END, least(CASE WHEN h>48 THEN {fit_w} ELSE w END,150) FROM d")
    out.append("SELECT w, h, 'rosetta_training', CASE WHEN h>48 OR w>150 THEN 48 ELSE h END, CASE WHEN h>48 OR w>150 THEN 150 ELSE w END FROM d")
    out.append(f"SELECT w, h, 'rosetta_inference', 48, {fit_w} FROM d")
    body = " UNION ALL ".join(out)
    return f"""SELECT doc_id, page_no, method, sum(nh)::bigint AS height, sum(nw)::bigint AS width,
        sum(CASE WHEN p THEN 150-nw ELSE 0 END)::bigint AS pad_right, sum(CASE WHEN p THEN 48-nh ELSE 0 END)::bigint AS pad_bottom
      FROM (SELECT *, method <> 'dynamic_w' AND (nh < 48 OR nw < 150) AS p FROM
        (SELECT w, h, method, CASE WHEN h=48 AND w=150 THEN h ELSE nh END AS nh, CASE WHEN h=48 AND w=150 THEN w ELSE nw END AS nw FROM plans))
      JOIN sized USING (w, h) GROUP BY ALL""", body


_RESIZE_BODY, _RESIZE_PLANS = _resize_sql()


@query("g8_resize_plan", with_tables(
    _RESIZE_BODY, "words",
    extra="sized AS MATERIALIZED (SELECT doc_id, page_no, r-l+1 AS w, 10 + (l+t) % 70 AS h FROM words),\n"
          f"d AS MATERIALIZED (SELECT DISTINCT w, h FROM sized),\nplans AS MATERIALIZED ({_RESIZE_PLANS})"))
def g8(t):
    """All methods for every word size; summed per page. A size is planned once, and words meet their size's plans as one row."""
    sized = t.words.select(*PAGE, (F.col("right") - F.col("left") + 1).alias("w"),
                           (10 + (F.col("left") + F.col("top")) % 70).alias("h"))
    plans = [B.resize_plan(F.col("h"), F.col("w"), m).alias(m) for m in B.RESIZE_METHODS]
    known = written(sized.select("w", "h").distinct().select("w", "h", *plans), "plans")
    columns = ("height", "width", "pad_right", "pad_bottom")
    sums = sized.join(sent_if_few(known), ["w", "h"]).groupBy(*PAGE).agg(
        *[total(f"{m}.{c}").alias(f"{m}_{c}") for m in B.RESIZE_METHODS for c in columns])
    rows = F.array(*[F.struct(F.lit(m).alias("method"), *[F.col(f"{m}_{c}").alias(c) for c in columns]) for m in B.RESIZE_METHODS])
    return sums.select(*PAGE, F.explode(rows).alias("r")).select(*PAGE, "r.*")


@query("g9_pyramid_side", with_tables(f"""
  SELECT {P}, greatest(((scale_w+31)//32)*32, 64)::bigint AS side_w, greatest(((scale_h+31)//32)*32, 64)::bigint AS side_h,
         greatest(((scale_w+3)//4)*4, 8)::bigint AS side_3 FROM page_dims""", "page_dims"))
def g9(t):
    return t.page_dims.select(*PAGE, B.pyramid_side(F.col("scale_w"), 6).alias("side_w"),
                              B.pyramid_side(F.col("scale_h"), 6).alias("side_h"),
                              B.pyramid_side(F.col("scale_w"), 3).alias("side_3"))


@query("g10_needs_split", with_tables(f"""
  SELECT {P}, count(*) FILTER (WHERE w > 150 AND w/h::double >= 8) AS wide, count(*) FILTER (WHERE (w > 150 OR h > 10) AND w/h::double >= 4) AS wide_4
  FROM wide_words GROUP BY ALL""", "wide_words"))
def g10(t):
    w, h = F.col("w"), F.col("h")
    return t.wide_words.groupBy(*PAGE).agg(
        F.count_if(B.needs_split(w, h)).alias("wide"),
        F.count_if(B.needs_split(w, h, max_height=10, ratio=4)).alias("wide_4"))


@query("g11_split_windows", with_tables("""
  SELECT doc_id, page_no, chunk, count(*) AS n, sum(lo)::bigint AS lo, sum(least(lo+149, w-1))::bigint AS hi FROM (
    SELECT *, chunk*130 AS lo FROM (
      SELECT *, unnest(CASE WHEN w > 150 AND w/h::double >= 8 THEN range(0, (w-1)//130 + 1) ELSE [0] END) AS chunk FROM wide_words)
    WHERE w > 150 AND w/h::double >= 8
    UNION ALL BY NAME SELECT *, 0 AS chunk, 0 AS lo FROM wide_words WHERE NOT (w > 150 AND w/h::double >= 8) AND w <= 150
    UNION ALL BY NAME SELECT doc_id, page_no, tag, word, h, w, 0 AS chunk, 0 AS lo FROM wide_words WHERE NOT (w/h::double >= 8) AND w > 150)
  GROUP BY ALL""".replace("least(lo+149, w-1)", "CASE WHEN w > 150 AND w/h::double >= 8 THEN least(lo+149, w-1) ELSE w-1 END"), "wide_words"))
def g11(t):
    cut = split_windows(t.wide_words, F.col("w"), F.col("h"), window=150, overlap=20)
    return cut.groupBy(*PAGE, "chunk").agg(F.count("*").alias("n"), total("from_x").alias("lo"), total("to_x").alias("hi"))


@query("f9_valid_box", with_tables(f"""
  SELECT {P}, count(*) FILTER (WHERE l < r AND t < b) AS valid, count(*) FILTER (WHERE r-l > 1 AND b-t > 1) AS strict
  FROM (SELECT doc_id, page_no, l, t, l+length(word)-2 AS r, b FROM words) GROUP BY ALL""", "words"))
def f9(t):
    thin = t.words.withColumn("right", F.col("left") + F.length("word") - 2)
    return thin.groupBy(*PAGE).agg(F.count_if(B.valid_box(Box.of())).alias("valid"),
                                   F.count_if(B.valid_box(Box.of(), strict=True)).alias("strict"))


@query("f10_min_size", with_tables(f"""
  SELECT {P}, tag FROM detections WHERE {area()} >= 600 AND least(r-l+1, b-t+1) >= 15""", "detections"))
def f10(t):
    kept = t.detections.filter(B.min_area(Box.of(), 600) & B.min_side(Box.of(), 15))
    return kept.select(*PAGE, "tag")


@query("f11_in_viewport", with_tables(f"""
  SELECT tag, (l < r AND t < b AND l >= 0 AND r < 1920 AND t >= 0 AND b < 1080) AS inside,
    (l < r AND t < b AND (l BETWEEN 0 AND 1920 OR r BETWEEN 0 AND 1920) AND (t BETWEEN 0 AND 1080 OR b BETWEEN 0 AND 1080)) AS touching
  FROM images""", "images"))
def f11(t):
    w, h = F.lit(1920), F.lit(1080)
    return t.images.select("tag", B.in_viewport(Box.of(), w, h).alias("inside"),
                           B.in_viewport(Box.of(), w, h, "touching").alias("touching"))
