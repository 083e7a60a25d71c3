"""Filters, normalisation and class-index coding over the word samples."""

from pyspark.sql import functions as F

from pagespark.catalog.registry import query
from pagespark.catalog.support import PAGE, big, total
from pagespark.fixtures.languages import FOLDED, LANGUAGES, sql_text
from pagespark.fixtures.sql import h, with_tables
from pagespark.functions.scores import argmax_steps
from pagespark.functions.text import (accepts, accepts_language, clean_text, decode, encode, max_length, no_emoji,
                                      no_icon_class, normalize)
from pagespark.operators.filters import (charset_union, clean_failures, drop_empty_files, pages_without_emoji, restyle_eligible,
                                         sample_view, same_direction, select_datasets, stable_pages, unrotated)
from pagespark.operators.html import html_words

EMOJI_SQL = r"'[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]'"


def accepted_sql(column: str, language: str) -> str:
    return f"translate({column}, {sql_text(LANGUAGES[language].accepting_charset)}, '') = ''"


def folded_sql(column: str) -> str:
    source = "".join(FOLDED.values())
    target = "".join(k * len(v) for k, v in FOLDED.items())
    return f"translate({column}, '{source}', '{target}')"


@query("f1_accepts", with_tables(
    "SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE {accepted_sql('word', n)}) AS {n}" for n in LANGUAGES)
    + " FROM words GROUP BY doc_id", "words"))
def f1(t):
    return t.words.groupBy("doc_id").agg(
        *[F.count_if(accepts(F.col("word"), lang.accepting_charset)).alias(n) for n, lang in LANGUAGES.items()])


@query("f2_accepting_charset", with_tables(f"""
  SELECT char, count(*) AS n_docs, bool_or(strpos({sql_text(LANGUAGES['french'].charset)}, char) > 0
      OR strpos('{"".join(FOLDED) + "".join(FOLDED.values())}', char) > 0) AS french
  FROM coverage GROUP BY char""", "coverage"))
def f2(t):
    """For each character of the documents, whether the mapped language accepts it."""
    accepting = list(LANGUAGES["french"].accepting_charset)
    return t.coverage.groupBy("char").agg(F.count("*").alias("n_docs")).withColumn("french", F.col("char").isin(accepting))


@query("f4_max_length", with_tables("""
  SELECT doc_id, count(*) FILTER (WHERE length(word) <= 8) AS short, count(*) FILTER (WHERE length(word) > 3 AND length(word) <= 12) AS mid
  FROM words GROUP BY doc_id""", "words"))
def f4(t):
    rest = F.substr(F.col("word"), F.lit(4))
    return t.words.groupBy("doc_id").agg(
        F.count_if(max_length(F.col("word"), 8)).alias("short"),
        F.count_if(max_length(rest, 9, non_empty=True)).alias("mid"))


@query("f5_no_emoji", with_tables(f"""
  SELECT doc_id, count(*) AS kept FROM emoji_samples WHERE NOT regexp_matches(text, {EMOJI_SQL}) GROUP BY doc_id""", "emoji_samples"))
def f5(t):
    return t.emoji_samples.filter(no_emoji(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("f5_pages_without_emoji", with_tables(f"""
  SELECT doc_id, page_no, count(*) AS words FROM emoji_samples GROUP BY ALL
  HAVING NOT bool_or(regexp_matches(text, {EMOJI_SQL}))""", "emoji_samples"))
def f5_pages(t):
    return pages_without_emoji(t.emoji_samples, PAGE).groupBy(*PAGE).agg(F.count("*").alias("words"))


@query("f5_no_icon_class", """
  SELECT page_id, count(*) AS elements, count(*) FILTER (WHERE NOT list_has_any(list_transform(string_split(c,' '), lambda x: lower(x)),
      ['material-icons','fa','fas','glyphicon','fab'])) AS plain
  FROM (SELECT page_id, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS c FROM pages) GROUP BY page_id""")
def f5_icons(t):
    classes = t.read("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('class="([^"]*)"'), 1)).alias("c"))
    return classes.groupBy("page_id").agg(
        F.count("*").alias("elements"), F.count_if(no_icon_class(F.split("c", " "))).alias("plain"))


@query("f6_same_direction", with_tables("SELECT doc_id, count(*) AS n FROM samples WHERE direction = 'ltr' GROUP BY doc_id", "samples"))
def f6(t):
    return t.samples.filter(same_direction(F.col("direction"), LANGUAGES["latin"])).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f7_unrotated", with_tables("SELECT doc_id, count(*) AS n FROM samples WHERE NOT coalesce(rotated, false) GROUP BY doc_id", "samples"))
def f7(t):
    return t.samples.filter(unrotated(F.col("rotated"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("f8_sample_view", with_tables(f"""
  SELECT tag, {folded_sql('text')} AS text, url FROM samples
  WHERE direction = 'ltr' AND length(text) <= 10 AND NOT regexp_matches(text, {EMOJI_SQL}) AND {accepted_sql('text', 'french')}""", "samples"))
def f8(t):
    return sample_view(t.samples, LANGUAGES["french"], max_len=10).select("tag", "text", "url")


@query("f12_restyle_eligible", with_tables("""
  SELECT doc_id, count(*) FILTER (WHERE h-7 > 7) AS loose, count(*) FILTER (WHERE w > 7 AND h > 7 AND NOT (direction = 'rtl')) AS clean
  FROM (SELECT doc_id, direction, w, h FROM samples) GROUP BY doc_id""".replace("h-7 > 7", "w-30 > 7 AND h > 7"), "samples"))
def f12(t):
    changed = F.col("direction") == "rtl"
    return t.samples.groupBy("doc_id").agg(
        F.count_if(restyle_eligible(F.col("h"), F.col("w") - 30, changed, clean_only=False)).alias("loose"),
        F.count_if(restyle_eligible(F.col("h"), F.col("w"), changed)).alias("clean"))


_WORDS_CTE = """hw AS MATERIALIZED (SELECT page_id, unnest(ws) AS word, generate_subscripts(ws,1)-1 AS pos FROM (
  SELECT page_id, list_filter(regexp_split_to_array(
    replace(replace(replace(replace(replace(replace(replace(replace(text,'&nbsp;',' '),'&copy;','©'),'&middot;','·'),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&amp;','&'),
    '[ \\x{00A0}\\t\\n\\r\\x{2002}\\x{2003}]+'), lambda x: x <> '') AS ws FROM html_text))"""


@query("f13_stable_pages", with_tables(f"""
  SELECT page_id FROM hw GROUP BY page_id HAVING NOT bool_or({h("concat('v|',page_id,'|',pos)")} % 4001 = 0)""",
  "html_text", extra=_WORDS_CTE))
def f13(t):
    """A word in some thousands differs in the second snapshot."""
    before = html_words(t.read("pages"))
    from pagespark.functions.hashing import hash_int
    other = F.when(hash_int("v", F.concat_ws("|", "page_id", "pos")) % 4001 == 0, F.concat("word", F.lit("~")))
    after = before.withColumn("word", F.coalesce(other, F.col("word")))
    return stable_pages(before, after, "page_id", "pos", ["word"])


@query("f14_clean_failures", with_tables("""
  SELECT * FROM files WHERE sample NOT IN (SELECT sample FROM files WHERE length = 0)""", "files"))
def f14(t):
    return clean_failures(t.files)


@query("f14_missing_labels", with_tables("""
  SELECT f.sample, f.file, f.length FROM files f
  WHERE f.length > 0 AND f.sample IN (SELECT sample FROM files WHERE file = 'data.json' AND length > 0)""", "files"))
def f14_labels(t):
    """Empty files go first, then samples that have lost their label file."""
    return clean_failures(drop_empty_files(t.files), label_file="data.json")


@query("s6_select_datasets", """
  SELECT name, kind FROM (SELECT DISTINCT concat(source, CASE WHEN lang = 'en' THEN '_real' ELSE '_made' END,
      CASE WHEN doc_id % 2 = 0 THEN '_train' ELSE '_val' END, CASE WHEN doc_id % 7 = 0 THEN '.zip' ELSE '' END) AS name FROM documents),
    (SELECT unnest(['all','real','synthetic']) AS kind)
  WHERE name NOT LIKE '%.zip%' AND name LIKE '%train%' AND (kind = 'all' OR (kind = 'real') = (name LIKE '%real%'))""")
def s6(t):
    name = F.concat("source", F.when(F.col("lang") == "en", "_Real").otherwise("_made"),
                    F.when(F.col("doc_id") % 2 == 0, "_train").otherwise("_val"),
                    F.when(F.col("doc_id") % 7 == 0, ".zip").otherwise(""))
    names = t.read("documents").select(name.alias("name")).distinct()
    parts = [select_datasets(names, kind, "train").withColumn("kind", F.lit(kind)) for kind in ("all", "real", "synthetic")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("name", F.replace("name", F.lit("_Real"), F.lit("_real")))


@query("x1_normalize", with_tables(f"SELECT tag, {folded_sql('word')} AS word FROM words", "words"))
def x1(t):
    return t.words.select("tag", normalize(F.col("word"), LANGUAGES["french"].mapping).alias("word"))


@query("x2_encode", with_tables(f"""
  SELECT tag, array_to_string(list_concat(list_transform(range(1,length(word)+1), lambda i: strpos(cs, word[i])-1),
      list_transform(range(0, greatest(0, 12-length(word))), lambda i: n)), ',') AS codes
  FROM words, charset""", "words", "charset"))
def x2(t):
    return t.words.select("tag", F.array_join(encode(F.col("word"), t.charset, 12), ",").alias("codes"))


@query("x3_decode", with_tables("""
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE same) AS back, sum(runs)::bigint AS runs FROM (
    SELECT doc_id, true AS same, length(regexp_replace(word, '', '')) -
      len(list_filter(range(2,length(word)+1), lambda i: word[i] = word[i-1])) AS runs
    FROM words) GROUP BY doc_id""", "words"))
def x3(t):
    """Plain decoding gives the word back; collapsing leaves one letter per run."""
    codes = t.words.withColumn("codes", encode(F.col("word"), t.charset, 20))
    return codes.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(decode(F.col("codes"), t.charset) == F.col("word")).alias("back"),
        total(F.length(decode(F.col("codes"), t.charset, "collapse"))).alias("runs"))


@query("x4_argmax_steps", with_tables("""
  SELECT tag, array_to_string(list_transform(scores, lambda s: list_position(s, list_max(s))-1), ',') AS classes FROM char_scores""", "char_scores"))
def x4(t):
    return t.char_scores.select("tag", F.array_join(argmax_steps(F.col("scores")), ",").alias("classes"))


@query("x11_clean_text", r"""
  SELECT doc_id, replace(translate(concat('{| |} ', text), chr(10) || chr(9), '  '), '{| |} ', '') AS text FROM documents""")
def x11(t):
    words = F.concat(F.array(F.lit("{|"), F.lit("|}")), F.split("text", " "))
    return t.documents.select("doc_id", clean_text(words).alias("text"))


@query("u3_charset_union", """
  SELECT DISTINCT char FROM (SELECT unnest(string_split(text, '')) AS char FROM documents WHERE lang IN ('de', 'en', 'es', 'fr') AND length(text) > 0)""")
def u3(t):
    """Charsets of the four languages put together."""
    chars = t.documents.filter(F.length("text") > 0).select("lang", F.explode(F.array_distinct(F.split("text", ""))).alias("char"))
    return charset_union([chars.filter(F.col("lang") == lang) for lang in ("de", "en", "es", "fr")])
