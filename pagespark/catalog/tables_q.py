"""Windows and ids, sources and sinks, splits and sampling, runs, links."""

from pyspark.sql import functions as F

from pagespark.catalog.joins_q import CHOICE_SQL  # noqa: F401
from pagespark.catalog.registry import query
from pagespark.catalog.support import LINE, PAGE, P, big, r6, tag_of, total
from pagespark.catalog.text_q import accepted_sql, folded_sql
from pagespark.fixtures.languages import LANGUAGES, sql_text
from pagespark.fixtures.sql import h, u, with_tables
from pagespark.fixtures.tables import Tables
from pagespark.functions.boxes import Box
from pagespark.functions.hashing import hash_int, hash_pick, hash_unit
from pagespark.operators import graph, html, order as O, runs as R, sampling as N, splits as S
from pagespark.operators.filters import restyle_eligible, sample_view
from pagespark.operators.joins import looked_up, pending_runs
from pagespark.session import remove_folder, scratch_path, shuffles_dropped, written
from pagespark.sources import coco, samples as SRC, shards
from pagespark.sources.members import write_files

WEIGHTS = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}


def dictionary(t):
    return O.numbered_in(t.source_words, ["source"], ["word"], "pos")


def epochs(t):
    return O.numbered_in(t.series, ["run"], ["ts", "event_id"], "epoch").drop("ts", "event_id")


# ---- windows and ids -------------------------------------------------------------

_BEST = "min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("w1_best_epochs", with_tables(f"SELECT run, epoch, val_loss, {_BEST} AS best_so_far, val_loss = {_BEST} AS is_best FROM epochs", "epochs"))
def w1(t):
    return R.best_epochs(epochs(t)).select("run", "epoch", "val_loss", "best_so_far", "is_best")


@query("w1_final_best", with_tables("""
  SELECT run, val_loss, max(epoch) AS best_epoch FROM epochs e WHERE val_loss = (SELECT min(val_loss) FROM epochs i WHERE i.run = e.run) GROUP BY ALL""", "epochs"))
def w1_final(t):
    return R.final_best(epochs(t)).select("run", "val_loss", "best_epoch")


@query("w2_resume_state", with_tables("""
  SELECT run, max(epoch) AS current_epoch, round(arg_max(train_loss, epoch),6) AS train_loss, arg_max(val_loss, epoch) AS val_loss,
    greatest(2000 - (max(epoch)+1), 0)::bigint AS epochs_left FROM epochs GROUP BY run""", "epochs"))
def w2(t):
    return R.resume_state(epochs(t), 2000).withColumn("train_loss", r6(F.col("train_loss")))


@query("w5_reading_order", with_tables(f"""
  SELECT tag, row_number() OVER (PARTITION BY {P} ORDER BY row_no, l, tag) - 1 AS reading_order FROM words""", "words"))
def w5(t):
    return O.reading_order(t.words.select(*PAGE, "row_no", "left", "tag"), PAGE, ["row_no", "left", "tag"]).select("tag", "reading_order")


@query("w6_global_ids", with_tables(f"""
  SELECT tag, row_number() OVER (ORDER BY doc_id, page_no, row_no, l, tag) - 1 AS id FROM words""", "words"))
def w6(t):
    return O.global_ids(t.words.select(*PAGE, "row_no", "left", "tag"), PAGE, ["row_no", "left", "tag"]).select("tag", "id")


@query("w7_shard_number", with_tables("""
  SELECT page_id, i // 37 AS by_size, i // ceil(n/7.0)::bigint AS by_parts
  FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS i, count(*) OVER () AS n FROM pages)"""))
def w7(t):
    pages = t.read("pages").select("page_id")
    ids = O.numbered(pages, ["page_id"])
    return ids.select("page_id", O.shard_number(F.col("id"), size=37).alias("by_size"),
                      O.shard_number(F.col("id"), O.row_total(pages), parts=7).alias("by_parts"))


@query("w8_keep_first", with_tables("SELECT url, min(pos) AS pos FROM link_list GROUP BY url", "link_list"))
def w8(t):
    return O.keep_first(t.link_list, ["url"], "pos")


@query("w9_positional_split", """
  SELECT url, CASE WHEN i < floor(0.85::double*n) THEN 'train' WHEN i < floor(0.95::double*n) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT url, row_number() OVER (ORDER BY page_id) - 1 AS i, count(*) OVER () AS n FROM pages)""")
def w9(t):
    pages = t.read("pages").select("page_id", "url")
    ids = O.numbered(pages, ["page_id"])
    return ids.select("url", O.positional_split(F.col("id"), O.row_total(pages)).alias("split"))


@query("w11_batch_padding", with_tables("""
  SELECT tag, max(w) OVER (PARTITION BY batch) - w AS pad FROM (
    SELECT tag, 10*length(word) AS w, (row_number() OVER (ORDER BY doc_id, page_no, row_no, l, tag) - 1) // 512 AS batch FROM words)""", "words"))
def w11(t):
    ids = O.global_ids(t.words.select(*PAGE, "row_no", "left", "tag", big(10 * F.length("word")).alias("w")), PAGE, ["row_no", "left", "tag"])
    return O.batch_padding(ids.withColumn("batch", O.shard_number(F.col("id"), size=512)), ["batch"], "w").select("tag", "pad")


# ---- sources and sinks -----------------------------------------------------------


def paged_samples(t):
    """Word samples with their page. Both sides are dealt out by document, so no word moves."""
    return looked_up(t.samples, t.words.select("doc_id", "tag", "page_no"), ["doc_id", "tag"])


def word_documents(t):
    """Word samples as the JSON documents sample folders hold, one per page."""
    entry = F.struct("text", F.array("h", "w").alias("image_size"), F.col("mask").alias("mask_file"), "rotated", "direction")
    pages = paged_samples(t).groupBy("doc_id", "page_no").agg(
        F.map_from_entries(F.collect_list(F.struct("file", entry))).alias("m"))
    path = F.concat_ws("/", F.lit("data"), "doc_id", "page_no", F.lit("recognition_data/data.json"))
    return pages.select(path.alias("path"), F.to_json("m", {"ignoreNullFields": "false"}).alias("value"))


def broken(documents, salt):
    """A tenth of the documents cut short, so that they are no JSON."""
    short = F.expr("substr(value, 1, length(value) - 3)")
    return documents.withColumn("value", F.when(hash_pick(10, salt, F.col("path")) == 0, short).otherwise(F.col("value")))


ROUND_CHARS = 1 << 25  # of documents whose sample files are there together, some 20 bytes each


def sample_files(t, *tables):
    """Write rows (path, value) as files to the shared folder; the root as Spark lists it."""
    root = scratch_path(t.spark, "samples")
    for table in tables:
        write_files(table, root)
    return root if ":" in root else f"file:{root}"


def in_rounds(t, make, read):
    """``read(part, root)`` over the files that ``make(part)`` writes under a root, for all documents. Sample files are many
    times as large as the documents, so a bounded part of these is taken at a time, and its files go when what was
    read of them is written."""
    chars = t.read("documents").agg(F.sum(F.length("text"))).first()[0] or 0
    rounds, out, found = -(-chars // ROUND_CHARS) or 1, scratch_path(t.spark, "read"), None
    for k in range(rounds):
        part = t if rounds == 1 else Tables(t.spark, t.folder, F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k)
        root = make(part)
        found = read(part, root)
        with shuffles_dropped(t.spark):
            found.write.mode("append").option("compression", "zstd").parquet(out)
        remove_folder(t.spark, root)
    return t.spark.read.schema(found.schema).parquet(out)


def inside(path):
    """A listed path from the samples' root on."""
    return F.regexp_extract(path, "(data/.*)$", 1)


def page_images(t):
    """An image file for all but a ninth of the pages."""
    path = F.concat_ws("/", F.lit("data"), "doc_id", "page_no", F.lit("detection_data/image.png"))
    return t.page_dims.select(path.alias("path"), F.lit("image").alias("value")).filter(hash_pick(9, "S5", F.col("path")) != 0)


@query("s1_read_word_samples", with_tables(f"""
  SELECT concat('data/', w.doc_id, '/', w.page_no, '/recognition_data/', s.file) AS path, s.text, s.h, s.w, s.mask AS mask_file, s.rotated, s.direction
  FROM samples s JOIN words w USING (tag)
  WHERE {h("concat('S1|data/', w.doc_id, '/', w.page_no, '/recognition_data/data.json')")} % 10 <> 0 AND {h("concat('S2|', s.tag)")} % 9 <> 0""", "samples", "words"))
def s1(t):
    """Word samples read back from sample files; some files are broken, some samples have no image file."""
    def read(t, root):
        images = paged_samples(t).filter(hash_pick(9, "S2", F.col("tag")) != 0)
        listed = F.concat_ws("/", F.lit(root), F.lit("data"), "doc_id", "page_no", F.lit("recognition_data"), "file")
        found = SRC.read_word_samples(t.spark, root, images=images.select(listed.alias("path")))
        return found.withColumn("path", inside(F.col("path"))).drop("file")

    return in_rounds(t, lambda t: sample_files(t, broken(word_documents(t), "S1")), read)


def page_documents(t):
    """Page samples as JSON documents. Words, images and sizes of a page are grouped as one table: what a page holds
    is too much to be sorted and moved for a join."""
    box = Box.of().struct()
    sizes = ["h", "w", "scale_w", "scale_h"]
    parts = t.words.select(*PAGE, "tag", "word", box.alias("box"))
    for other in (t.images.select(*PAGE, "tag", box.alias("image")), t.page_dims.select(*PAGE, *sizes)):
        parts = parts.unionByName(other, allowMissingColumns=True)
    by_tag = lambda value, box: F.map_from_entries(F.collect_list(F.when(F.col(box).isNotNull(), F.struct("tag", value))))
    whole = parts.groupBy(*PAGE).agg(
        by_tag("word", "box").alias("tags_to_text"), by_tag("box", "box").alias("tags_to_bounding_boxes_text"),
        by_tag("image", "image").alias("tags_to_bounding_boxes_images"), *[F.max(c).alias(c) for c in sizes])
    path = F.concat_ws("/", F.lit("data"), "doc_id", "page_no", F.lit("detection_data/data.json"))
    doc = F.struct(
        "tags_to_text", "tags_to_bounding_boxes_text", "tags_to_bounding_boxes_images", F.array("h", "w").alias("image_size"),
        F.array("scale_w", "scale_h").alias("num_pixels_each_class"), F.concat(F.lit("http://site/"), "doc_id").alias("url"),
        (F.col("page_no") % 2 == 0).alias("background_changed"), F.lit("ltr").alias("direction"))
    return whole.select(path.alias("path"), F.to_json(doc).alias("value"))


@query("s2_read_page_samples", with_tables(f"""
  SELECT d.doc_id, d.page_no, concat('http://site/', d.doc_id) AS url, d.h, d.w, n AS num_words, d.page_no % 2 = 0 AS background_changed,
    scale_w AS zeros, scale_h AS ones, sl AS boxes_left, sr AS boxes_right
  FROM page_dims d JOIN (SELECT {P}, count(*) AS n, sum(l)::bigint AS sl, sum(r)::bigint AS sr FROM words GROUP BY ALL) USING (doc_id, page_no)
  WHERE {h("concat('S3|data/', doc_id, '/', page_no, '/detection_data/data.json')")} % 10 <> 0
    AND {h("concat('S5|data/', doc_id, '/', page_no, '/detection_data/image.png')")} % 9 <> 0""", "page_dims", "words"))
def s2(t):
    """Page samples read back from files; some files are broken, some pages have no image."""
    def read(t, root):
        pages = SRC.read_page_samples(t.spark, root).withColumn("folder", inside(F.col("folder")))
        read = SRC.parse_page_samples(SRC.read_documents(t.spark, root, "detection_data"))  # boxes are summed up before a join moves pages
        boxes = SRC.page_boxes(read.withColumn("folder", inside(F.col("folder"))), "tags_to_bounding_boxes_text").filter(F.col("text").isNotNull()).groupBy("folder").agg(
            total("left").alias("boxes_left"), total("right").alias("boxes_right"))
        part = lambda i: big(F.get(F.split("folder", "/"), i))
        return pages.join(boxes, "folder").select(
            part(1).alias("doc_id"), part(2).alias("page_no"), "url", "h", "w", "num_words", "background_changed", "zeros", "ones",
            "boxes_left", "boxes_right")

    return in_rounds(t, lambda t: sample_files(t, broken(page_documents(t), "S3"), page_images(t)), read)


def layout_documents(t):
    """Layout samples as JSON documents, paragraphs and their words in order."""
    par = big(F.floor(F.col("row_no") / 5)).alias("par")
    listed = lambda *items: F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)
    box = F.to_json(Box.of().struct())
    triples = t.words.select(*PAGE, par, "tag", listed(quoted("tag"), box, quoted("word")).alias("w"))
    parts = triples.unionByName(t.paragraphs.select(*PAGE, "par", box.alias("box")), allowMissingColumns=True)
    in_order = lambda key, text: F.transform(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(key, text)))), lambda x: x[text])
    pars = parts.groupBy(*PAGE, "par").agg(F.max("box").alias("box"), in_order("tag", "w").alias("words"))
    pairs = pars.select(*PAGE, "par", listed("box", listed("words")).alias("pair"))
    pages = pairs.groupBy(*PAGE).agg(in_order("par", "pair").alias("pairs"))
    path = F.concat_ws("/", F.lit("data"), "doc_id", "page_no", F.lit("layout_data/data.json"))
    return pages.select(path.alias("path"), F.concat(F.lit('{"paragraphs":'), listed("pairs"), F.lit("}")).alias("value"))


@query("s3_read_layout_samples", with_tables(f"""
  SELECT concat('data/', p.doc_id, '/', p.page_no, '/layout_data') AS folder, p.par AS paragraph, p.l AS "left", p.t AS "top", p.r AS "right", p.b AS "bottom",
    row_number() OVER (PARTITION BY w.doc_id, w.page_no, w.row_no//5 ORDER BY w.tag) - 1 AS pos, w.tag, w.l AS word_left, w.word AS text
  FROM paragraphs p JOIN words w ON p.doc_id = w.doc_id AND p.page_no = w.page_no AND p.par = w.row_no//5""", "paragraphs", "words"))
def s3(t):
    def read(t, root):
        out = SRC.read_layout_samples(t.spark, root)
        return out.withColumn("folder", inside(F.col("folder"))).withColumn("word_left", F.col("word_box.left")).drop("word_box")

    return in_rounds(t, lambda t: sample_files(t, layout_documents(t)), read)


@query("s4_read_light", with_tables("""
  SELECT concat('data/', doc_id, '/', page_no, '/detection_data/data.json') AS path, concat('http://site/', doc_id) AS url, scale_w AS zeros, scale_h AS ones FROM page_dims""", "page_dims"))
def s4(t):
    def read(t, root):
        pages, _ = SRC.read_light(t.spark, root)
        return pages.withColumn("path", inside(F.col("path")))

    return in_rounds(t, lambda t: sample_files(t, page_documents(t)), read)


@query("s4_light_words", with_tables("SELECT concat('data/', file) AS path FROM samples", "samples"))
def s4_words(t):
    names = t.samples.select(F.explode(F.array("file", "mask", F.concat("tag", F.lit(".txt")))).alias("name"))
    return SRC.light_words(names.select(F.concat(F.lit("data/"), "name").alias("path")))


def image_tree(t):
    """An empty document for every page beside the image that all but a ninth have, from one look at the words."""
    path = lambda name: F.concat_ws("/", F.lit("data"), "doc_id", "page_no", F.lit(f"detection_data/{name}"))
    image, document = [F.struct(path(name).alias("path"), F.lit(value).alias("value")) for name, value in (("image.png", "image"), ("data.json", "{}"))]
    there = hash_pick(9, "S5", image["path"]) != 0
    return t.page_dims.select(*PAGE).select(F.explode(F.array_compact(F.array(document, F.when(there, image)))).alias("f")).select("f.*")


@query("s5_list_images", with_tables(f"""
  SELECT concat('data/', doc_id, '/', page_no, '/detection_data/image.png') AS path, NULL::varchar AS text, NULL::boolean AS rotated FROM page_dims
  WHERE {h("concat('S5|data/', doc_id, '/', page_no, '/detection_data/image.png')")} % 9 <> 0""", "page_dims"))
def s5(t):
    """Images of a tree of files that holds documents too, one of each page's."""
    def read(t, root):
        return SRC.list_images(t.spark, root).withColumn("path", inside(F.col("path"))).select("path", "text", "rotated")

    return in_rounds(t, lambda t: sample_files(t, image_tree(t)), read)


@query("s7_discover_pages", with_tables("""
  SELECT kind, path FROM page_paths WHERE regexp_matches(path, '\\.(html?|mhtml)$') AND
    (path NOT LIKE '%/%' OR (len(string_split(path,'/')) <= 3 AND regexp_matches(path, '(^|/)index\\.[^/]*$')))""", "page_paths"))
def s7(t):
    return html.discover_pages(t.page_paths).select("kind", "path")


@query("s8_save_load_view", with_tables(f"""
  SELECT lang, count(*) AS samples, sum(length(text))::bigint AS letters, 'french' AS language FROM samples
  WHERE direction = 'ltr' AND {accepted_sql('text', 'french')} GROUP BY lang""", "samples"))
def s8(t):
    path = scratch_path(t.spark, "view")
    SRC.save_view(sample_view(t.samples, LANGUAGES["french"], allow_emoji=True), path, {"language": "french"}, ["lang"])
    rows, settings = SRC.load_view(t.spark, path)
    return rows.groupBy("lang").agg(F.count("*").alias("samples"), total(F.length("text")).alias("letters")).withColumn(
        "language", F.lit(settings["language"]))


_COCO_ROWS = """ann AS MATERIALIZED (SELECT doc_id, page_no, 1::bigint AS category_id, tag, l, t, r, b, word AS text FROM words
  UNION ALL SELECT doc_id, page_no, 2, tag, l, t, r, b, NULL FROM images),
img AS MATERIALIZED (SELECT doc_id, page_no, row_number() OVER (ORDER BY doc_id, page_no) AS image_id, w, h FROM page_dims)"""


def _file_name():
    return F.concat_ws("/", F.lit("data"), "doc_id", "page_no", F.lit("image.png"))


@query("s9_coco_images", with_tables("""
  SELECT image_id AS id, concat('data/', doc_id, '/', page_no, '/image.png') AS file_name, h AS height, w AS width, '2013-11-18 02:53:27' AS date_captured FROM img""",
  "words", "images", "page_dims", extra=_COCO_ROWS))
def s9_images(t):
    return coco.coco_images(t.page_dims, PAGE, _file_name()).drop(*PAGE)


@query("s9_coco_detection", with_tables("""
  SELECT row_number() OVER (ORDER BY doc_id, page_no, category_id, tag) AS id, image_id, category_id, concat_ws(',', l, t, r-l, b-t) AS bbox,
    concat_ws(',', l, t, l, b, r, b, r, t) AS segmentation, text FROM ann JOIN img USING (doc_id, page_no)""",
  "words", "images", "page_dims", extra=_COCO_ROWS))
def s9(t):
    _, rows = coco.coco_detection(t.page_dims, t.words, t.images, PAGE, "tag", _file_name())
    return rows.select("id", "image_id", big(F.col("category_id")).alias("category_id"), F.array_join("bbox", ",").alias("bbox"),
                       F.array_join(F.get("segmentation", 0), ",").alias("segmentation"), "text")


@query("s10_coco_layout", with_tables("""
  SELECT row_number() OVER (ORDER BY doc_id, page_no, par) AS id, image_id, concat_ws(',', l, t, r-l, b-t) AS bbox
  FROM paragraphs JOIN img USING (doc_id, page_no)""", "words", "images", "page_dims", "paragraphs", extra=_COCO_ROWS))
def s10(t):
    _, rows = coco.coco_layout(t.page_dims, t.paragraphs, PAGE, "par", _file_name())
    return rows.select("id", "image_id", F.array_join("bbox", ",").alias("bbox"))


def sentences(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.select("doc_id", big(F.col("line_no")).alias("line_no"), "text")


_SENTENCES = """sent AS MATERIALIZED (SELECT doc_id, line_no, text, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS i, count(*) OVER () AS n FROM (
  SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls,1)-1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


@query("s11_shard_corpus", with_tables("SELECT i AS \"index\", text, i // ceil(n/27.0)::bigint + 1 AS part FROM sent", extra=_SENTENCES))
def s11(t):
    return shards.shard_corpus(sentences(t), ["line_no"], 27, group=["doc_id"]).select("index", "text", "part")


@query("s12_shard_samples", with_tables("""
  SELECT tag, i // 1000 + 1 AS shard, i % 1000 AS key, text FROM (
    SELECT s.tag, s.text, row_number() OVER (ORDER BY w.doc_id, w.page_no, w.row_no, w.l, w.tag) - 1 AS i FROM samples s JOIN words w USING (tag))""", "samples", "words"))
def s12(t):
    rows = t.words.select(*PAGE, "row_no", "left", "tag", F.col("word").alias("text"))
    return shards.shard_samples(rows, ["row_no", "left", "tag"], size=1000, group=PAGE).select("tag", "shard", "key", "text")


@query("s12_shard_pages", with_tables(f"""
  SELECT {P}, i // ceil(n/4.0)::bigint + 1 AS shard, i % ceil(n/4.0)::bigint AS key FROM (
    SELECT {P}, row_number() OVER (ORDER BY {P}) - 1 AS i, count(*) OVER () AS n FROM page_dims)""", "page_dims"))
def s12_pages(t):
    return shards.shard_samples(t.page_dims.select(*PAGE), list(PAGE), parts=4).select(*PAGE, "shard", "key")


@query("s12_written_shards", with_tables("""
  SELECT tag, i // 1000 + 1 AS shard, i % 1000 AS key, concat(i % 1000, '.png') AS sample_file, text, h, w, direction FROM (
    SELECT s.*, row_number() OVER (ORDER BY w.doc_id, w.page_no, w.row_no, w.l, w.tag) - 1 AS i FROM samples s JOIN words w USING (tag))""", "samples", "words"))
def s12_written(t):
    """Re-keyed samples with their labels, written, written again, and read back."""
    labels = t.samples.select("doc_id", "tag", "file", "text", "h", "w", "direction")
    words = looked_up(t.words.select(*PAGE, "row_no", "left", "tag"), labels, ["doc_id", "tag"])
    rows = shards.shard_samples(words, ["row_no", "left", "tag"], size=1000, group=PAGE)
    rows = rows.withColumn("sample_file", shards.rekeyed(F.col("file"), F.col("key"))).select(
        "tag", "key", "sample_file", "text", "h", "w", "direction", "shard")
    rows = written(rows, "samples")  # both versions are written from it, and ranges are looked for in it
    path = scratch_path(t.spark, "shards")
    for _ in range(2):
        shards.write_shards(rows, path)
    return shards.read_shards(t.spark, path, "tag string, key bigint, sample_file string, text string, h bigint, w bigint, direction string, shard bigint")


@query("s13_iter_batches", """
  SELECT i // 333 AS batch, count(*) AS rows, min(event_id) AS first, max(event_id) AS last
  FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY ALL""")
def s13(t):
    """One summary row per batch handed out."""
    events = t.read("events").select("event_id")
    return shards.batched(events, ["event_id"], size=333).groupBy("batch").agg(F.count("*").alias("rows"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("s14_rename_extension", with_tables("""
  SELECT tag, concat(tag, '.jpg') AS file, mask FROM samples""", "samples"))
def s14(t):
    return t.samples.select("tag", shards.rename_extension(F.col("file")).alias("file"), shards.rename_extension(F.col("mask")).alias("mask"))


@query("s15_extension_counts", with_tables("SELECT sample AS archive, count(*) AS members, count(*) FILTER (WHERE file LIKE '%png%') AS matching FROM files GROUP BY sample", "files"))
def s15(t):
    return shards.extension_counts(t.files.withColumnRenamed("sample", "archive"), "archive", "file")


@query("s16_write_predictions", with_tables("""
  SELECT concat(doc_id, '/', page_no) AS file, string_agg(text, chr(10) ORDER BY line_id) AS prediction FROM lines GROUP BY doc_id, page_no""", "lines"))
def s16(t):
    from pagespark.operators.aggregates import concat_text
    texts = concat_text(t.lines, PAGE, ["line_id"], "\n").select(F.concat_ws("/", *PAGE).alias("file"), "text")
    path = scratch_path(t.spark, "predictions")
    SRC.write_predictions(texts, path)
    return SRC.read_predictions(t.spark, path)


# ---- splits, repeats and set operations --------------------------------------------


@query("j15_split_by_key", with_tables(f"SELECT tag, CASE WHEN {u('''concat('split|', url)''')} < 0.8 THEN 'train' ELSE 'val' END AS split FROM samples", "samples"))
def j15(t):
    return t.samples.select("tag", S.hash_split(F.col("url"), 0.8).alias("split"))


@query("n8_hash_split", with_tables(f"SELECT doc_id, CASE WHEN {u('''concat('rows|', doc_id)''')} < 0.7 THEN 'train' ELSE 'val' END AS split FROM documents"))
def n8(t):
    return t.read("documents").select("doc_id", S.hash_split(F.col("doc_id"), 0.7, "rows").alias("split"))


@query("n8_exact_split", with_tables(f"""
  SELECT tag, CASE WHEN row_number() OVER (ORDER BY {h("concat('exact|', tag)")}, tag) <= floor(0.8::double * count(*) OVER ()) THEN 'train' ELSE 'val' END AS split FROM words""", "words"))
def n8_exact(t):
    return S.exact_split(t.words.select("tag"), "tag", 0.8, "exact")


@query("u1_combine_datasets", with_tables(f"""
  SELECT dataset, sample, row_number() OVER (ORDER BY dataset, sample) - 1 AS combined_id,
    CASE WHEN {u("concat('split|', source)")} < 0.8 THEN 'train' ELSE 'val' END AS split
  FROM (SELECT CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS dataset, doc_id AS sample, source FROM documents)
  WHERE sample NOT IN (SELECT sample FROM files WHERE length = 0)""", "files"))
def u1(t):
    docs = t.read("documents").select(F.col("doc_id").alias("sample"), "lang", "source")
    parts = {"a": docs.filter(F.col("lang") == "en").drop("lang"), "b": docs.filter(F.col("lang") != "en").drop("lang")}
    return S.combine_datasets(parts, "sample", t.files, "source").drop("source")


@query("u2_validation_rest", with_tables(f"SELECT doc_id FROM documents WHERE {u('''concat('rows|', doc_id)''')} >= 0.7"))
def u2(t):
    docs = t.read("documents").select("doc_id")
    train = docs.filter(S.hash_split(F.col("doc_id"), 0.7, "rows") == "train")
    return S.validation_rest(docs, train, ["doc_id"])


@query("t4_cycle_to", """
  SELECT slot, page_id FROM (SELECT unnest(range(0, (SELECT count(*) FROM pages)*5//2 + 3)) AS slot)
  JOIN (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS i FROM pages) ON i = slot % (SELECT count(*) FROM pages)""")
def t4(t):
    ids = O.numbered(t.read("pages").select("page_id"), ["page_id"])
    n = F.floor(O.row_total(t.read("pages")) * 5 / 2) + 3
    return S.cycle_to(ids, n.cast("bigint")).select("slot", "page_id")


@query("t5_words_in_order", with_tables("""
  SELECT slot, source, word FROM (SELECT unnest(range(0, (SELECT count(*) FROM source_words)*3//2)) AS slot)
  JOIN (SELECT source, word, row_number() OVER (ORDER BY source, word) - 1 AS i FROM source_words) ON i = slot % (SELECT count(*) FROM source_words)""", "source_words"))
def t5(t):
    ids = O.numbered(t.source_words, ["source", "word"])
    n = F.floor(O.row_total(t.source_words) * 3 / 2).cast("bigint")
    return N.words_in_order(ids, n).select("slot", "source", "word")


@query("t6_repeat_to", """
  SELECT item_id, copy FROM benchmark, (SELECT unnest(range(0, (SELECT ceil((SELECT count(*) FROM documents) / (SELECT count(*) FROM benchmark)::double)::bigint))) AS copy)""")
def t6(t):
    return S.repeat_to(t.read("benchmark").select("item_id"), O.row_total(t.read("documents"))).select("item_id", "copy")


# ---- draws ---------------------------------------------------------------------------

_ENDS = [end for _, end in N.cumulated(WEIGHTS)]


def _source_sql(unit: str) -> str:
    return f"CASE WHEN {unit} < {_ENDS[0]}::double THEN 'en' WHEN {unit} < {_ENDS[1]}::double THEN 'de' WHEN {unit} < {_ENDS[2]}::double THEN 'fr' ELSE 'es' END"


@query("n1_weighted_draw", with_tables("SELECT s.tag, s.source, d.word FROM s JOIN dictionary d USING (source, pos)", "words", "dictionary", extra=f"""
  z AS MATERIALIZED (SELECT source, count(*) AS n FROM dictionary GROUP BY source),
  s AS MATERIALIZED (SELECT tag, source, {h("concat('draw#|',tag)")} % n AS pos
    FROM (SELECT tag, {_source_sql(u("concat('draw|',tag)"))} AS source FROM words) JOIN z USING (source))"""))
def n1(t):
    return N.weighted_draw(t.words.select("tag"), ["tag"], WEIGHTS, dictionary(t)).select("tag", "source", "word")


@query("n2_init_weights", """
  SELECT source, round(1.0/count(*) OVER (),6) AS uniform, CASE source WHEN 'src1' THEN 0.5 WHEN 'src2' THEN 0.25 ELSE 0 END::double AS given
  FROM (SELECT DISTINCT source FROM documents)""")
def n2(t):
    items = t.read("documents").select("source").distinct()
    even = N.init_weights(items, "source").select("source", r6(F.col("weight")).alias("uniform"))
    given = N.init_weights(items, "source", {"src1": 0.5, "src2": 0.25}).withColumnRenamed("weight", "given")
    return even.join(given, "source")


@query("n3_drop_and_share", f"""
  SELECT source, round(w + (SELECT sum(w) FROM c WHERE d)/(SELECT count(*) FROM c WHERE NOT d),6) AS weight FROM c WHERE NOT d""".replace(
  "SELECT source, round", f"WITH c AS (SELECT source, count(*)/(SELECT count(*) FROM documents) AS w, {h('''concat('drop|',source)''')} % 4 = 0 AS d FROM documents GROUP BY source) SELECT source, round", 1))
def n3(t):
    docs = t.read("documents")
    weights = docs.groupBy("source").agg(F.count("*").alias("n")).withColumn("weight", F.col("n") / O.row_total(docs)).drop("n")
    return N.drop_and_share(weights, hash_pick(4, "drop", F.col("source")) == 0).withColumn("weight", r6(F.col("weight")))


@query("n4_fill_weights", f"""
  SELECT lang, source, round(coalesce(w, (1 - coalesce(sum(w) OVER (PARTITION BY lang),0))/count(*) FILTER (WHERE w IS NULL) OVER (PARTITION BY lang)),6) AS weight
  FROM (SELECT lang, source, CASE WHEN {h("concat('fill|',lang,'|',source)")} % 2 = 0 THEN n/1000000.0::double END AS w
    FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL))""")
def n4(t):
    counts = t.read("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    known = F.when(hash_pick(2, "fill", F.col("lang"), F.col("source")) == 0, F.col("n") / 1000000.0)
    return N.fill_weights(counts.withColumn("weight", known).drop("n"), "lang").withColumn("weight", r6(F.col("weight")))


@query("n5_load_dictionary", with_tables(f"SELECT source, pos, word FROM dictionary WHERE length(word) <= 9 AND {accepted_sql('word', 'latin')}", "dictionary"))
def n5(t):
    return N.load_dictionary(dictionary(t), LANGUAGES["latin"], 9)


@query("n5_load_dictionary_compat", with_tables(f"""
  SELECT source, pos, word FROM dictionary d WHERE length(word) <= 9 AND pos < coalesce((SELECT min(pos) FROM dictionary x
    WHERE x.source = d.source AND length(x.word) <= 9 AND NOT ({accepted_sql('x.word', 'latin')})), 1e15)""", "dictionary"))
def n5_compat(t):
    return N.load_dictionary(dictionary(t), LANGUAGES["latin"], 9, compat=True)


AUGMENT = {"grayscale": 0.3, "perspective_transformation": 0.25, "paste_text_on_natural_background": 0.4,
           "paste_text_on_texture_background": 0.5, "add_natural_background_to_image": 0.3, "add_texture_background_to_image": 0.6}
STEPS = {name: i for i, name in enumerate(N.TRANSFORM_ORDER)}


def _augment_sql() -> str:
    drawn = ", ".join(f"{u(f'''concat('augment|{n}|',tag)''')} < {p}::double AS {n}" for n, p in AUGMENT.items())
    rule = {
        "paste_text_on_texture_background": " AND NOT paste_text_on_natural_background",
        "add_natural_background_to_image": " AND NOT perspective_transformation",
        "add_texture_background_to_image": " AND NOT perspective_transformation AND NOT add_natural_background_to_image",
    }
    rows = " UNION ALL ".join(
        f"SELECT doc_id, '{n}' AS transform, {STEPS[n]}::bigint AS step FROM drawn WHERE {n}{rule.get(n, '')}" for n in AUGMENT)
    return with_tables(f"SELECT doc_id, transform, step, count(*) AS samples FROM ({rows}) GROUP BY ALL", "samples",
                       extra=f"drawn AS MATERIALIZED (SELECT doc_id, {drawn} FROM samples)")


@query("n6_plan_augmentations", _augment_sql())
def n6(t):
    plan = N.plan_augmentations(t.samples, "tag", AUGMENT)
    doc = big(F.substring_index("tag", "|", 1))
    return plan.groupBy(doc.alias("doc_id"), "transform", "step").agg(F.count("*").alias("samples"))


@query("n7_replace_words", with_tables("""
  SELECT w.tag, coalesce(n.word, w.word) AS word, n.word IS NOT NULL AS replaced FROM words w LEFT JOIN n USING (tag)""", "words", "dictionary", extra=f"""
  c AS MATERIALIZED (SELECT tag, concat(doc_id,'|',page_no,'|',(row_number() OVER (PARTITION BY {P} ORDER BY row_no, l, tag) - 1) % 20) AS k
    FROM words WHERE {u("concat('replace|',tag)")} < 0.3),
  z AS MATERIALIZED (SELECT source, count(*) AS n FROM dictionary GROUP BY source),
  s AS MATERIALIZED (SELECT tag, source, {h("concat('replace-pool#|',k)")} % n AS pos FROM (SELECT *, {_source_sql(u("concat('replace-pool|',k)"))} AS source FROM c) JOIN z USING (source)),
  n AS MATERIALIZED (SELECT s.tag, d.word FROM s JOIN dictionary d USING (source, pos))"""))
def n7(t):
    """Words of a page replaced from its pool of twenty drawn words (row W12 is its turn)."""
    words = t.words.select(*PAGE, "row_no", "left", "tag", "word")
    return N.replace_words(words, PAGE, ["row_no", "left", "tag"], "tag", 0.3, WEIGHTS, dictionary(t), pool=20).select("tag", "word", "replaced")


@query("w12_replacement_turn", with_tables(f"""
  SELECT tag, (row_number() OVER (PARTITION BY {P} ORDER BY row_no, l, tag) - 1) % 20 AS turn FROM words WHERE {u("concat('replace|',tag)")} < 0.3""", "words"))
def w12(t):
    chosen = t.words.filter(hash_unit("replace", F.col("tag")) < 0.3)
    return O.reading_order(chosen, PAGE, ["row_no", "left", "tag"], "n").select("tag", (F.col("n") % 20).alias("turn"))


STYLES = {"ink": 0.5, "scan": 0.3, "fax": 0.2}


@query("n9_assign_style", with_tables(f"""
  SELECT tag, CASE WHEN m < 0.5::double THEN 'ink' WHEN m < 0.8::double THEN 'scan' ELSE 'fax' END AS model
  FROM (SELECT *, {u("concat('style-model|',tag)")} AS m FROM samples WHERE w > 7 AND h > 7 AND direction <> 'rtl' AND {u("concat('style|',tag)")} < 0.25)""", "samples"))
def n9(t):
    eligible = restyle_eligible(F.col("h"), F.col("w"), F.col("direction") == "rtl")
    return N.assign_style(t.samples, "tag", eligible, 0.25, STYLES).select("tag", "model")


_LETTERS = "abcdefghijklmnopqrstuvwxyzäöü0123456789-."


@query("n10_random_words", f"""
  SELECT event_id, array_to_string(list_transform(range(1, n+1), lambda i: substr('{_LETTERS}', ({h("concat('word|',event_id,'|',i)")} % {len(_LETTERS)} + 1)::bigint, 1)), '') AS word
  FROM (SELECT event_id, 1 + {h("concat('word|',event_id)")} % 37 AS n FROM events)""")
def n10(t):
    return N.random_words(t.read("events").select("event_id"), "event_id", _LETTERS, 38)


def _dates_sql() -> str:
    d = lambda what, n: h(f"concat('date|{what}|',event_id)") + f" % {n}"
    two = lambda c: f"CASE WHEN length({c}) < 2 THEN concat('0',{c}) ELSE {c} END"
    return f"""SELECT event_id, CASE WHEN isd THEN CASE WHEN ord = 0 THEN concat(c,ds,b,ds,a) ELSE concat(b,ds,c,ds,a) END
      ELSE CASE WHEN short = 0 THEN concat(a,cs,b) ELSE concat(a,cs,b,cs,c) END END AS word FROM (
      SELECT *, CASE WHEN pad OR (length(a) = 2 AND length(b) = 2) THEN {two('z')} ELSE z END AS c FROM (
        SELECT *, CASE WHEN pad THEN {two('x')} ELSE x END AS a, CASE WHEN pad THEN {two('y')} ELSE y END AS b FROM (
          SELECT event_id, {d('kind', 2)} = 0 AS isd, {d('pad', 2)} = 0 AS pad, {d('order', 2)} AS ord, {d('short', 2)} AS short,
            ['/','-','.'][{d('separator', 3)} + 1] AS ds, [':','.'][{d('separator', 2)} + 1] AS cs,
            CASE WHEN {d('kind', 2)} = 0 THEN 1900 + {d('year', 130)} ELSE {d('hour', 24)} END::varchar AS x,
            CASE WHEN {d('kind', 2)} = 0 THEN 1 + {d('month', 12)} ELSE {d('minute', 60)} END::varchar AS y,
            CASE WHEN {d('kind', 2)} = 0 THEN 1 + {d('day', 31)} ELSE {d('second', 60)} END::varchar AS z FROM events)))"""


@query("n11_random_dates", _dates_sql())
def n11(t):
    return N.random_dates(t.read("events").select("event_id"), "event_id")


@query("n12_pick_token", f"""
  SELECT doc_id, ws[({h("concat('token|',doc_id)")} % len(ws)) + 1] AS token FROM (SELECT doc_id, string_split(translate(text, chr(10)||chr(9), '  '), ' ') AS ws FROM documents)""")
def n12(t):
    return t.documents.select("doc_id", N.pick_token(F.col("text"), "token", F.col("doc_id")).alias("token"))


@query("w10_fill_text", with_tables("""
  SELECT doc_id, target, arg_min(text, k) AS text FROM (
    SELECT doc_id, target, k, array_to_string(ws[1:k], ' ') AS text FROM (
      SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n FROM (
        SELECT doc_id, target, ws, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM fillwalk WHERE chars >= target)) WHERE n >= target)
  GROUP BY ALL""", recursive=True, extra=_SENTENCES + f""",
  fillwalk AS (SELECT doc_id, 1 + n_chars % 180 AS target, 0::bigint AS turn, []::varchar[] AS ws, -1::bigint AS chars FROM documents
    UNION ALL SELECT doc_id, target, turn + 1, list_concat(ws, new), chars + list_sum(list_transform(new, lambda w: length(w) + 1))::bigint
    FROM (SELECT d.*, CASE WHEN {h("concat('fill-skip|',doc_id,'|',turn)")} % 2 = 0 AND len(parts) > 1 THEN parts[2:] ELSE parts END AS new
      FROM (SELECT *, {h("concat('fill|',doc_id,'|',turn)")} % (SELECT count(*) FROM sent) AS i FROM fillwalk WHERE chars < target) d
      JOIN (SELECT i, string_split(replace(text, chr(9), ' '), ' ') AS parts FROM sent) s USING (i)))"""))
def w10(t):
    slots = t.read("documents").select("doc_id", (1 + F.col("n_chars") % 180).alias("target"))
    corpus = O.global_ids(sentences(t), ["doc_id"], ["line_no"], "id")
    return N.fill_text(slots, "doc_id", "target", corpus)


# ---- runs, links ---------------------------------------------------------------------

GRID = {"loss": ("nll", "ctc"), "encoder": ("lstm", "transformer"), "decoder": ("linear", "transformer"), "position": ("sin", "learned"), "init": ("init", "no_init")}
_GRID_SQL = """grid AS MATERIALIZED (SELECT *, concat_ws('_', source, loss, encoder, decoder, position, init) AS run FROM (
  SELECT source, loss, encoder, decoder, unnest(CASE WHEN encoder = 'transformer' OR decoder = 'transformer' THEN ['sin','learned'] ELSE ['const'] END) AS position, init
  FROM (SELECT DISTINCT source FROM documents), (SELECT unnest(['nll','ctc']) AS loss), (SELECT unnest(['lstm','transformer']) AS encoder),
    (SELECT unnest(['linear','transformer']) AS decoder), (SELECT unnest(['init','no_init']) AS init)))"""


def _grid(t):
    return R.config_grid(t.read("documents").select("source").distinct(), "source", GRID)


@query("j16_config_grid", with_tables("SELECT * FROM grid", extra=_GRID_SQL))
def j16(t):
    return _grid(t)


@query("j17_pending_runs", with_tables(f"SELECT run FROM grid WHERE NOT ({h('''concat('done|',run)''')} % 3 = 0)", extra=_GRID_SQL))
def j17(t):
    done = _grid(t).filter(hash_pick(3, "done", F.col("run")) == 0)
    return pending_runs(_grid(t), done).select("run")


@query("j14_crawl_frontier", with_tables("""
  SELECT page_id, min(depth) AS depth FROM walk GROUP BY page_id""", "link_graph", recursive=True, extra=f"""
  picked AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {h("concat('walk|',src,'|',dst)")}, dst) AS r
    FROM (SELECT DISTINCT src, dst FROM link_graph)) WHERE r <= 2),
  walk(page_id, depth) AS (SELECT 0::bigint, 0::bigint UNION SELECT p.dst, w.depth + 1 FROM walk w JOIN picked p ON p.src = w.page_id WHERE w.depth < 14)"""))
def j14(t):
    return graph.crawl_frontier(t.link_graph, 0)


@query("x10_extract_links", """
  SELECT page_id, href, concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), href) AS url FROM (
    SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) WHERE href LIKE '/%'""")
def x10(t):
    return html.extract_links(t.read("pages"), "/", base="url")


_ENTITY = "replace(replace(replace(replace(replace(replace(replace(replace(text,'&nbsp;',' '),'&copy;','©'),'&middot;','·'),'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&#39;',''''),'&amp;','&')"


@query("x8_html_words", with_tables(f"""
  SELECT page_id, generate_subscripts(ws,1)-1 AS pos, unnest(ws) AS word FROM (SELECT page_id, list_filter(regexp_split_to_array({_ENTITY},
    '[ \\x{{00A0}}\\t\\n\\r\\x{{2002}}\\x{{2003}}]+'), lambda x: x <> '') AS ws FROM html_text)""", "html_text"))
def x8(t):
    return html.html_words(t.read("pages"))


def _sql_list(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_INNER = "list_reverse(stack)"
_FIRST, _SECOND = (_sql_list(c) for c in html.PARAGRAPH_TAGS)
_PIECE_SQL = html.PIECE.replace("++", "+").replace("*+", "*").replace("'", "''")
# One piece of every page a step: the open elements are a list, an end tag cuts it at the innermost element of its name.
NODES_SQL = f"""RECURSIVE pieces AS MATERIALIZED (
  SELECT page_id, i, piece, name, CASE WHEN NOT tag THEN 'text' WHEN name = '' THEN 'other' WHEN starts_with(piece, '</') THEN 'end'
      WHEN name IN {_sql_list(sorted(html.VOID_TAGS))} THEN 'other' WHEN ends_with(piece, '/>') OR regexp_matches(piece, '{html.RAW_END}') THEN 'whole' ELSE 'start' END AS kind,
    CASE WHEN tag THEN []::varchar[] ELSE list_filter(regexp_split_to_array({_ENTITY.replace("text,", "piece,", 1)}, '[ \\x{{00A0}}\\t\\n\\r\\x{{2002}}\\x{{2003}}]+'), lambda x: x <> '') END AS ws
  FROM (SELECT *, starts_with(piece, '<') AND piece <> '<' AS tag, lower(regexp_extract(piece, '{html.NAME}', 1)) AS name FROM (
    SELECT page_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS piece FROM (SELECT page_id, regexp_extract_all(html, '{_PIECE_SQL}') AS ps FROM pages)))),
walk AS (
  SELECT page_id, 0::bigint AS i, [{{'id': 0::bigint, 'tag': 'body'}}] AS stack, 0::bigint AS seen FROM pages
  UNION ALL
  SELECT w.page_id, p.i, CASE WHEN kind = 'start' THEN list_append(stack, {{'id': seen + 1, 'tag': name}})
      WHEN kind = 'end' AND coalesce(list_position(list_transform({_INNER}, lambda e: e.tag), name), 0) BETWEEN 1 AND len(stack) - 1
        THEN stack[1:len(stack) - list_position(list_transform({_INNER}, lambda e: e.tag), name)] ELSE stack END,
    seen + CASE WHEN kind IN ('start', 'whole') THEN 1 ELSE 0 END
  FROM walk w JOIN pieces p ON p.page_id = w.page_id AND p.i = w.i + 1),
nodes AS MATERIALIZED (
  SELECT page_id, i, ws, stack[-1].tag AS tag, coalesce(list_filter({_INNER}, lambda e: e.tag IN {_FIRST})[1], list_filter({_INNER}, lambda e: e.tag IN {_SECOND})[1], stack[-1]) AS par,
    row_number() OVER before - 1 AS node, (coalesce(sum(len(ws)) OVER (before ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS first
  FROM walk JOIN pieces USING (page_id, i)
  WHERE kind = 'text' AND len(ws) > 0 AND len(list_filter(stack, lambda e: e.tag IN {_sql_list(html.SKIPPED + html.EMPTIED)})) = 0
  WINDOW before AS (PARTITION BY page_id ORDER BY i))"""


@query("x8_html_nodes", f"""WITH {NODES_SQL}
  SELECT page_id, unnest(ws) AS word, node, first + generate_subscripts(ws, 1) - 1 AS pos, tag, par.id AS paragraph, par.tag AS paragraph_tag FROM nodes""")
def x8_nodes(t):
    """Words with the element they stand in and their nearest paragraph element."""
    return html.html_nodes(t.read("pages"))


@query("x9_paragraph_of", f"""WITH {NODES_SQL}
  SELECT page_id, par.id AS paragraph, par.tag AS paragraph_tag, sum(len(ws))::bigint AS words, min(first) AS first, max(first + len(ws) - 1) AS last FROM nodes GROUP BY ALL""")
def x9(t):
    return html.paragraph_of(t.read("pages"))
