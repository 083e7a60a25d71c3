"""Box joins, word joins and aggregations."""

from pyspark.sql import functions as F

from pagespark.catalog.registry import query
from pagespark.catalog.support import LINE, PAGE, P, SIDES_SQL, area, big, envelope_aggs, inter, r6, total, v_iou
from pagespark.catalog.text_q import accepted_sql
from pagespark.fixtures.languages import LANGUAGES
from pagespark.fixtures.sql import h, with_tables
from pagespark.fixtures.tables import SCRIPTS
from pagespark.functions.boxes import Box, inter_area
from pagespark.functions.hashing import hash_int, hash_pick
from pagespark.functions.text import accepts
from pagespark.operators import aggregates as A
from pagespark.operators import joins as J
from pagespark.operators.chunks import merge_chunks, split_windows
from pagespark.operators.lines import merge_fragments

# The oracle's levenshtein counts bytes: two-byte letters stand in as single control characters.
_WIDE = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_NARROW = " || ".join(f"chr({1 + i})" for i in range(len(_WIDE)))
LEV = "levenshtein(" + ", ".join(f"translate({c}, '{_WIDE}', {_NARROW})" for c in ("target", "predicted")) + ")"

MEET = "a.l <= o.r AND o.l <= a.r AND a.t <= o.b AND o.t <= a.b"
SAME = "a.doc_id = o.doc_id AND a.page_no = o.page_no"


@query("j1_box_join", with_tables(f"""
  SELECT a.doc_id, a.page_no, count(*) AS pairs, sum({inter('a.', 'o.')})::bigint AS shared
  FROM detections a JOIN images o ON {SAME} AND {MEET} GROUP BY ALL""", "detections", "images"))
def j1(t):
    """Words under pictures: pairs and shared pixels per page."""
    pairs = J.box_join(t.detections.select(*PAGE, "tag", *Box.of().sides), t.images, PAGE)
    return pairs.groupBy(*PAGE).agg(F.count("*").alias("pairs"), total(inter_area(Box.of(), Box.of("o_"))).alias("shared"))


@query("j1_self_overlaps", with_tables(f"""
  SELECT a.doc_id, a.page_no, count(*) AS pairs, sum({inter('a.', 'o.')})::bigint AS shared
  FROM detections a JOIN detections o ON {SAME} AND {MEET} AND concat(a.tag,'|',a.k) < concat(o.tag,'|',o.k) GROUP BY ALL""", "detections"))
def j1_self(t):
    boxes = t.detections.select(*PAGE, F.concat_ws("|", "tag", "k").alias("key"), *Box.of().sides)
    pairs = J.box_join(boxes, boxes, PAGE, F.col("key") < F.col("o_key"))
    return pairs.groupBy(*PAGE).agg(F.count("*").alias("pairs"), total(inter_area(Box.of(), Box.of("o_"))).alias("shared"))


@query("j2_assign_lines", with_tables(f"""
  SELECT a.doc_id, a.page_no, a.line_id, min(o.par) AS par FROM lines a LEFT JOIN paragraphs o
    ON {SAME} AND {inter('a.', 'o.')} >= 0.8::double * {area('a.')} GROUP BY ALL""", "lines", "paragraphs"))
def j2(t):
    out = J.assign_first(t.lines.drop("text"), t.paragraphs, PAGE, [*PAGE, "line_id"], "par")
    return out.select(*PAGE, "line_id", "par")


@query("j3_lines_in_paragraph", with_tables(f"""
  SELECT a.doc_id, a.page_no, a.line_id, o.par FROM lines a JOIN paragraphs o
    ON {SAME} AND {MEET} AND {inter('a.', 'o.')} >= 0.9::double * {area('a.')}""", "lines", "paragraphs"))
def j3(t):
    return J.lines_in_paragraph(t.lines.drop("text"), t.paragraphs, PAGE).select(*PAGE, "line_id", F.col("o_par").alias("par"))


@query("j4_boxes_without_overlap", with_tables(f"""
  SELECT a.tag, {SIDES_SQL.replace('l AS', 'a.l AS').replace('t AS', 'a.t AS').replace('r AS', 'a.r AS').replace('b AS', 'a.b AS')} FROM images a
  WHERE NOT EXISTS (SELECT 1 FROM words o WHERE {SAME} AND {MEET})""", "images", "words"))
def j4(t):
    return J.boxes_without_overlap(t.images, t.words, PAGE, [*PAGE, "tag"]).drop(*PAGE)


@query("j5_adjacent_fragments", with_tables(f"""
  SELECT a.tag, o.tag AS next_tag, round({v_iou('a.', 'o.')}, 6) AS v_iou FROM fragments a JOIN fragments o
    ON {SAME} AND a.r = o.l AND {v_iou('a.', 'o.')} >= 0.5 AND a.tag <> o.tag""", "fragments"))
def j5(t):
    pairs = J.adjacent_fragments(t.fragments.select(*PAGE, "tag", *Box.of().sides), PAGE)
    return pairs.select("tag", F.col("o_tag").alias("next_tag"), r6(F.col("v_iou")).alias("v_iou"))


@query("j6_suppression_pairs", with_tables(f"""
  SELECT a.k1 AS key, o.k1 AS other FROM keyed a JOIN keyed o ON {SAME} AND a.k1 < o.k1 AND {MEET}
    AND {inter('a.', 'o.')} >= 0.5::double * least({area('a.')}, {area('o.')})""", "detections",
    extra="keyed AS MATERIALIZED (SELECT *, concat(tag,'|',k) AS k1 FROM detections)"))
def j6(t):
    boxes = t.detections.select(*PAGE, F.concat_ws("|", "tag", "k").alias("key"), *Box.of().sides)
    return J.suppression_pairs(boxes, PAGE, "key").select("key", F.col("o_key").alias("other"))


@query("j7_pending_links", with_tables("""
  SELECT url, min(pos) AS pos FROM link_list WHERE url NOT IN (SELECT url FROM used) GROUP BY url""", "link_list", "used"))
def j7(t):
    return J.pending_links(t.link_list, t.used)


_EDGES = f"""edges AS MATERIALIZED (SELECT a.tag, o.tag AS next_tag FROM fragments a JOIN fragments o
    ON {SAME} AND a.r = o.l AND {v_iou('a.', 'o.')} >= 0.5 AND a.tag <> o.tag)"""


@query("j8_recognition_samples", with_tables("""
  SELECT doc_id, count(*) AS samples, sum(r-l+1)::bigint AS width, sum(b-t+1)::bigint AS height FROM fragments
  WHERE tag NOT IN (SELECT tag FROM edges UNION SELECT next_tag FROM edges) GROUP BY doc_id""", "fragments", extra=_EDGES))
def j8(t):
    pieces = t.fragments.select(*PAGE, "tag", "word", *Box.of().sides)
    edges = J.adjacent_fragments(pieces, PAGE)
    changed = edges.select(*PAGE, F.explode(F.array("tag", "o_tag")).alias("tag"))
    kept = J.recognition_samples(pieces, changed, [*PAGE, "tag"])
    return kept.groupBy("doc_id").agg(F.count("*").alias("samples"), total("width").alias("width"), total("height").alias("height"))


def _chunk_texts(t):
    """Each window of a wide word reads as the word's letters dealt out in turn."""
    cut = split_windows(t.wide_words, F.col("w"), F.col("h"))
    return cut.withColumn("text", F.concat("chunk", F.lit(":"), F.substring("word", 1, 3)))


CHUNKS_SQL = """chunks AS MATERIALIZED (SELECT *, unnest(CASE WHEN w > 150 AND w/h::double >= 8 THEN range(0, (w-1)//150 + 1) ELSE [0] END) AS chunk FROM wide_words)"""


@query("j9_merge_chunks", with_tables("""
  SELECT tag, string_agg(concat(chunk, ':', substr(word,1,3)), '' ORDER BY chunk) AS text FROM chunks GROUP BY tag""", "wide_words", extra=CHUNKS_SQL))
def j9(t):
    return merge_chunks(_chunk_texts(t), [*PAGE, "tag"], "append_text").drop(*PAGE)


@query("j10_attach_text", with_tables(f"""
  SELECT w.doc_id, count(*) AS words, count(predicted) AS read, count(*) FILTER (WHERE predicted = word) AS same
  FROM words w LEFT JOIN (SELECT * FROM recognised WHERE {h("concat('p|',tag)")} % 13 <> 0) s USING (tag) GROUP BY w.doc_id""", "words", "recognised"))
def j10(t):
    """Some words have no reading; they stay, with a null text."""
    texts = t.recognised.filter(hash_int("p", F.col("tag")) % 13 != 0).select("tag", "predicted")
    joined = J.attach_text(t.words.select("doc_id", "tag", "word"), texts, ["tag"])
    return joined.groupBy("doc_id").agg(F.count("*").alias("words"), F.count("predicted").alias("read"),
                                        F.count_if(F.col("predicted") == F.col("word")).alias("same"))


READINGS_SQL = """readings AS MATERIALIZED (SELECT tag, 'latin' AS recogniser, predicted AS text FROM recognised
  UNION ALL SELECT tag, 'german', reverse(predicted) FROM recognised)"""
CHOICE_SQL = f"""choice AS MATERIALIZED (SELECT tag, CASE WHEN {h("concat('g|',tag)")} % 3 = 0 THEN 'german' ELSE 'latin' END AS script FROM words)"""


def readings(t):
    texts = F.array(F.struct(F.lit("latin").alias("recogniser"), F.col("predicted").alias("text")),
                    F.struct(F.lit("german").alias("recogniser"), F.reverse("predicted").alias("text")))
    return t.recognised.select(*PAGE, "tag", F.explode(texts).alias("x")).select(*PAGE, "tag", "x.recogniser", "x.text")


def choices(t):
    script = F.when(hash_pick(3, "g", F.col("tag")) == 0, "german").otherwise("latin")
    return t.words.select(*PAGE, "tag", script.alias("script"))


@query("j11_pick_text", with_tables("""
  SELECT tag, text, script FROM readings r JOIN choice c USING (tag) WHERE r.recogniser = c.script""",
  "recognised", extra=READINGS_SQL + ", " + CHOICE_SQL))
def j11(t):
    return J.pick_text(readings(t), choices(t), [*PAGE, "tag"]).select("tag", "text", "script")


@query("j12_covers_charset", with_tables("""
  SELECT item FROM coverage WHERE strpos('acefiouyé', char) > 0 GROUP BY item HAVING count(DISTINCT char) = 9""", "coverage"))
def j12(t):
    return J.covers_charset(t.coverage, "item", "char", "acefiouyé")


LABELS_SQL = "labelled AS MATERIALIZED (SELECT tag, doc_id, " + ", ".join(
    f"({accepted_sql('text', n)})::int AS {n}" for n in LANGUAGES) + " FROM samples)"


def _labels(t):
    views = {n: accepts(F.col("text"), lang.accepting_charset) for n, lang in LANGUAGES.items()}
    return J.script_labels_of(t.samples, views, "doc_id", "file").drop("doc_id")


@query("j13_script_labels", with_tables("SELECT concat(tag,'.png') AS file, latin, german, french, spanish FROM labelled WHERE latin+german+french+spanish > 0",
                                        "samples", extra=LABELS_SQL))
def j13(t):
    return _labels(t)


@query("j18_paragraphs_from_rows", with_tables(f"""
  SELECT {P}, block_num, par_num, l AS "left", t AS "top", l+width AS "right", t+height AS "bottom" FROM layout_rows p WHERE level = 3
    AND EXISTS (SELECT 1 FROM layout_rows w WHERE w.level = 5 AND w.doc_id = p.doc_id AND w.page_no = p.page_no
      AND w.par_num = p.par_num AND length(replace(w.text,' ','')) > 0)""", "layout_rows"))
def j18(t):
    return J.paragraphs_from_rows(t.layout_rows, PAGE)


@query("a1_envelope", with_tables(f"""
  SELECT {P}, row_no, min(l) AS "left", min(t) AS "top", max(r) AS "right", max(b) AS "bottom" FROM words GROUP BY ALL""", "words"))
def a1(t):
    return A.envelope(t.words, LINE)


PIXELS_SQL = """pixels AS MATERIALIZED (SELECT doc_id, page_no, w*h - coalesce(ones,0) AS zeros, coalesce(ones,0) AS ones FROM page_dims LEFT JOIN (
  SELECT doc_id, page_no, sum(greatest(0, r - greatest(coalesce(reach, l-1), l-1)))::bigint AS ones FROM (
    SELECT *, max(r) OVER (PARTITION BY doc_id, page_no, y ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM (SELECT doc_id, page_no, l, r, unnest(range(t, b+1)) AS y FROM detections)) GROUP BY ALL) USING (doc_id, page_no))"""


@query("a2_class_pixels", with_tables("SELECT * FROM pixels", "page_dims", "detections", extra=PIXELS_SQL))
def a2(t):
    return A.class_pixels(t.page_dims, t.detections, PAGE)


@query("a3_class_balance", with_tables("""
  SELECT 'share' AS form, round(sum(zeros/(zeros+ones)),6) AS class_0, round(sum(ones/(zeros+ones)),6) AS class_1 FROM pixels
  UNION ALL SELECT 'count', sum(zeros)::double, sum(ones)::double FROM pixels""", "page_dims", "detections", extra=PIXELS_SQL))
def a3(t):
    pixels = A.class_pixels(t.page_dims, t.detections, PAGE)
    forms = [A.class_balance(pixels).withColumn("form", F.lit("share")), A.class_balance(pixels, True).withColumn("form", F.lit("count"))]
    return forms[0].unionByName(forms[1]).select("form", r6(F.col("class_0")).alias("class_0"), r6(F.col("class_1")).alias("class_1"))


@query("a4_class_weights", with_tables("""
  SELECT round(1 - c0/(c0+c1),6) AS weight_0, round(1 - c1/(c0+c1),6) AS weight_1
  FROM (SELECT sum(zeros/(zeros+ones)) AS c0, sum(ones/(zeros+ones)) AS c1 FROM pixels)""", "page_dims", "detections", extra=PIXELS_SQL))
def a4(t):
    weights = A.class_weights(A.class_balance(A.class_pixels(t.page_dims, t.detections, PAGE)))
    return weights.select(r6(F.col("weight_0")).alias("weight_0"), r6(F.col("weight_1")).alias("weight_1"))


@query("a5_script_counts", with_tables("""
  SELECT CASE WHEN """ + h("concat('m|',tag)") + """ / 4294967296.0 < 0.8 THEN 'train' ELSE 'val' END AS split, script, sum(CASE script WHEN 'latin' THEN latin WHEN 'german' THEN german
     WHEN 'french' THEN french ELSE spanish END)::bigint AS samples
  FROM labelled, (SELECT unnest(['latin','german','french','spanish']) AS script) WHERE latin+german+french+spanish > 0 GROUP BY ALL""", "samples", extra=LABELS_SQL))
def a5(t):
    from pagespark.functions.hashing import hash_unit
    tag = F.expr("substr(file, 1, length(file) - 4)")
    split = F.when(hash_unit("m", tag) < 0.8, "train").otherwise("val")
    return A.script_counts(_labels(t).withColumn("split", split), "split", list(LANGUAGES))


@query("a6_concat_text", with_tables(f"SELECT {P}, row_no, string_agg(word, ' ' ORDER BY l, tag) AS text FROM words GROUP BY ALL", "words"))
def a6(t):
    return A.concat_text(t.words.withColumnRenamed("word", "text"), LINE, ["left", "tag"], " ")


@query("a7_sum_scores", with_tables("""
  SELECT doc_id, page_no, script, round(sum(score),6) AS score FROM script_scores GROUP BY ALL""", "script_scores"))
def a7(t):
    summed = merge_chunks(t.script_scores, PAGE, "scores_sum")
    return summed.select(*PAGE, "script", r6(F.col("score")).alias("score"))


@query("a8_corpus_weights", """
  SELECT source, count(*) AS paragraphs, round(count(*)/(SELECT sum(len(string_split(text, chr(10)))) FROM documents),6) AS weight
  FROM (SELECT source, unnest(string_split(text, chr(10))) FROM documents) GROUP BY source""")
def a8(t):
    lines = t.documents.select("source", F.explode(F.split("text", "\n")).alias("line"))
    return A.corpus_weights(lines, "source").withColumn("weight", r6(F.col("weight")))


@query("a9_url_usage", with_tables("SELECT url, count(*) AS uses FROM link_list GROUP BY url", "link_list"))
def a9(t):
    return A.url_usage(t.link_list)


@query("a10_failure_report", with_tables("""
  SELECT count(*) AS files, count(*) FILTER (WHERE length = 0) AS empty_files, count(DISTINCT sample) AS samples,
    count(DISTINCT sample) FILTER (WHERE length = 0) AS failed_samples FROM files""", "files"))
def a10(t):
    return A.failure_report(t.files)


@query("a10_view_sizes", with_tables("SELECT source, count(*) AS size FROM source_words GROUP BY source", "source_words"))
def a10_sizes(t):
    return A.view_sizes(t.source_words, "source")


@query("a11_epoch_loss", with_tables("""
  SELECT run, epoch, round(sum(loss)/sum(n),6) AS by_samples, round(sum(loss)/count(*),6) AS by_batches FROM batches GROUP BY ALL""", "batches"))
def a11(t):
    one, two = A.epoch_loss(t.batches), A.epoch_loss(t.batches, "batches")
    return one.withColumnRenamed("loss", "x").join(two, ["run", "epoch"]).select(
        "run", "epoch", r6(F.col("x")).alias("by_samples"), r6(F.col("loss")).alias("by_batches"))


@query("a12_compare_runs", """
  SELECT event_type AS run, max(epoch_us(ts))::bigint AS duration, max(user_id) AS num_parameters, min(value) AS best_val_loss
  FROM events GROUP BY ALL""")
def a12(t):
    runs = t.read("events").select(F.col("event_type").alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("duration"),
                                   F.col("user_id").alias("num_parameters"), F.col("value").alias("val_loss"))
    return A.compare_runs(runs)


@query("a12_compare_scores", with_tables(f"""
  SELECT lang AS test_set, source AS model, round(avg((target = predicted)::int),6) AS exact,
         round(sum({LEV})/sum(length(target)),6) AS cer
  FROM recognised JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id) GROUP BY ALL""", "recognised"))
def a12_scores(t):
    pairs = t.recognised.join(t.read("documents").select("doc_id", "lang", "source"), "doc_id")
    scores = A.recognition_scores(pairs, ["lang", "source"]).select(
        F.col("lang").alias("test_set"), F.col("source").alias("model"),
        F.explode(F.create_map(F.lit("exact"), "exact", F.lit("cer"), "cer")).alias("metric", "value"))
    return A.compare_scores(scores, ["exact", "cer"]).select(
        "test_set", "model", r6(F.col("exact")).alias("exact"), r6(F.col("cer")).alias("cer"))


@query("a13_tall_words", with_tables(f"""
  SELECT tag, b-t+1 AS height FROM (SELECT *, median(b-t+1) OVER (PARTITION BY doc_id, page_no, row_no) AS m FROM (
    SELECT doc_id, page_no, row_no, tag, t, b + CASE WHEN {h("concat('a|',tag)")} % 20 = 0 THEN 16 ELSE 0 END AS b FROM words))
  WHERE b-t+1 > 1.75::double * m""", "words"))
def a13(t):
    grown = F.when(hash_pick(20, "a", F.col("tag")) == 0, 16).otherwise(0)
    words = t.words.withColumn("bottom", F.col("bottom") + grown)
    return A.tall_words(words, LINE).select("tag", (F.col("bottom") - F.col("top") + 1).alias("height"))


@query("a14_words_per_page", with_tables(f"SELECT {P}, count(*) AS num_words FROM words GROUP BY ALL", "words"))
def a14(t):
    return A.words_per_page(t.words, PAGE)


@query("a15_recognition_scores", with_tables(f"""
  SELECT doc_id, round(avg((target = predicted)::int),6) AS exact, round(sum({LEV})/sum(length(target)),6) AS cer
  FROM recognised GROUP BY doc_id""", "recognised"))
def a15(t):
    return A.recognition_scores(t.recognised, ["doc_id"]).select("doc_id", r6(F.col("exact")).alias("exact"), r6(F.col("cer")).alias("cer"))
