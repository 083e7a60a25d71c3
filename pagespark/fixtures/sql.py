"""The derived tables once more, as SQL for the oracle. Boxes are l, t, r, b here."""

from __future__ import annotations

from pagespark.operators.html import EMPTIED, SKIPPED, VOID_TAGS


def h(key: str) -> str:
    return f"(concat('0x',substr(md5({key}),1,8))::bigint)"


def u(key: str) -> str:
    return f"({h(key)}/4294967296.0)"


PK = "concat(doc_id,'|',page_no)"
LK = "concat(doc_id,'|',page_no,'|',row_no)"


def clean_html(column: str) -> str:
    out = column
    for tag in SKIPPED:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    for tag in (t for t in EMPTIED if t not in VOID_TAGS):
        out = f"regexp_replace({out}, '(?i)<{tag}\\b[^>]*>[^<]*', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g')"
    return f"regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g')"


# name -> (needed names, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "tok": ((), """
      SELECT doc_id, lang, line_no, unnest(ws) AS word, generate_subscripts(ws,1)-1 AS pos FROM (
        SELECT doc_id, lang, line_no, list_filter(string_split(line,' '), lambda x: x <> '') AS ws FROM (
          SELECT doc_id, lang, unnest(ls) AS line, generate_subscripts(ls,1)-1 AS line_no
          FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents)))"""),
    "words": (("tok",), f"""
      SELECT doc_id, lang, k//60 AS page_no, k%60 AS row_no, line_no, pos, tag, word, row_len, l,
             20*(k%60) + {h("concat('j|',tag)")} % 5 AS t, (l + 10*length(word) - 1)::bigint AS r,
             20*(k%60) + {h("concat('j|',tag)")} % 5 + 13 AS b
      FROM (SELECT *, concat(doc_id,'|',line_no,'|',pos) AS tag,
              dense_rank() OVER (PARTITION BY doc_id ORDER BY line_no, pos//12) - 1 AS k,
              count(*) OVER (PARTITION BY doc_id, line_no, pos//12) AS row_len,
              (10*coalesce(sum(length(word)+1) OVER (PARTITION BY doc_id, line_no, pos//12 ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS l
            FROM tok)"""),
    "page_dims": (("words",), f"""
      SELECT doc_id, page_no, w, 1240::bigint AS h, 300 + {h(f"concat('s|',{PK})")} % 9000 AS scale_w,
             300 + {h(f"concat('t|',{PK})")} % 9000 AS scale_h
      FROM (SELECT doc_id, page_no, max(r)+1 AS w FROM words GROUP BY ALL)"""),
    "detections": (("words",), f"""
      SELECT doc_id, page_no, row_no, tag, k, word, l+2*k AS l, t+k AS t, r+3*k AS r, b+2*k AS b
      FROM (SELECT *, unnest(CASE WHEN {h("concat('d|',tag)")} % 5 = 0 THEN [0,1] ELSE [0] END)::bigint AS k FROM words)"""),
    "two_col": (("words",), f"""
      SELECT doc_id, page_no, row_no, tag, word, l+6000*m AS l, t-600*m AS t, r+6000*m AS r, b-600*m AS b
      FROM (SELECT *, CASE WHEN {h("concat('c|',doc_id)")} % 2 = 1 AND row_no >= 30 THEN 1 ELSE 0 END AS m FROM words)"""),
    "fragments": (("words",), f"""
      WITH c AS (SELECT *, length(word)//2 AS half, (length(word) >= 6 AND {h("concat('f|',tag)")} % 4 = 0) AS cut FROM words)
      SELECT doc_id, page_no, row_no, tag AS source, concat(tag,'|0') AS tag,
             CASE WHEN cut THEN substr(word,1,half) ELSE word END AS word, l, t,
             CASE WHEN cut THEN l+10*half ELSE r END AS r, b FROM c
      UNION ALL
      SELECT doc_id, page_no, row_no, tag, concat(tag,'|1'), substr(word,half+1), l+10*half, t, r, b FROM c WHERE cut"""),
    "images": (("words",), f"""
      SELECT doc_id, page_no, k AS tag, l, t, l+19+{h("concat('iw|',k)")}%200 AS r, t+19+{h("concat('ih|',k)")}%200 AS b
      FROM (SELECT *, {h("concat('il|',k)")}%2000 AS l, {h("concat('it|',k)")}%1200 AS t FROM (
        SELECT doc_id, page_no, concat(doc_id,'|',page_no,'|',i) AS k
        FROM (SELECT DISTINCT doc_id, page_no FROM words), (SELECT unnest([0,1,2]) AS i)))"""),
    "paragraphs": (("words",), """
      SELECT doc_id, page_no, row_no//5 AS par, min(l) AS l, min(t) AS t, max(r) AS r,
             max(b) + CASE WHEN (row_no//5) % 3 = 2 THEN 22 ELSE 0 END AS b
      FROM words GROUP BY doc_id, page_no, row_no//5"""),
    "line_words": (("words",), f"""
      SELECT *, CASE WHEN {h(f"concat('l|',{LK})")} % 3 = 0 AND row_len >= 2 AND pos % 12 >= row_len//2 THEN 1 ELSE 0 END AS piece
      FROM words"""),
    "lines": (("line_words",), """
      SELECT doc_id, page_no, row_no, piece, row_no*2+piece AS line_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b,
             string_agg(word, ' ' ORDER BY l, tag) AS text
      FROM line_words GROUP BY doc_id, page_no, row_no, piece"""),
    "layout_rows": (("page_dims", "paragraphs", "words"), f"""
      SELECT doc_id, page_no, 2::bigint AS level, 0::bigint AS block_num, 0::bigint AS par_num, 0::bigint AS l, 0::bigint AS t, w AS width, h AS height, NULL AS text FROM page_dims
      UNION ALL SELECT doc_id, page_no, 3, 0, par, l, t, r-l, b-t, NULL FROM paragraphs
      UNION ALL SELECT doc_id, page_no, 5, 0, row_no//5, l, t, r-l, b-t,
             CASE WHEN {h("concat('b|',tag)")} % 4 = 0 THEN '  ' ELSE word END FROM words"""),
    "samples": (("words",), f"""
      SELECT w.doc_id, w.lang, w.tag, w.word AS text,
             CASE WHEN {h("concat('r|',w.tag)")} % 10 = 0 THEN 'rtl' ELSE 'ltr' END AS direction,
             CASE {h("concat('o|',w.tag)")} % 20 WHEN 1 THEN true WHEN 2 THEN NULL ELSE false END AS rotated,
             14::bigint AS h, 10*length(w.word) AS w, concat(w.tag,'.png') AS file, concat(w.tag,'_mask.png') AS mask, p.url
      FROM words w LEFT JOIN pages p ON p.page_id = w.doc_id % (SELECT count(*) FROM pages)"""),
    "emoji_samples": (("words",), f"""
      SELECT doc_id, page_no, tag, concat(word, CASE WHEN {h("concat('e|',tag)")} % 50 = 0 THEN chr(128512) ELSE '' END) AS text FROM words"""),
    "files": ((), f"""
      SELECT sample, file, CASE WHEN x % 50 = 0 THEN 0 ELSE 1 + x % 1000 END AS length
      FROM (SELECT *, {h("concat('z|',sample,'|',file)")} AS x FROM (
        SELECT doc_id AS sample, unnest(['data.json','image.png','mask.png']) AS file FROM documents))"""),
    "coverage": ((), """
      SELECT doc_id AS item, unnest(list_distinct(string_split(text,''))) AS char FROM documents WHERE length(text) > 0"""),
    "source_words": (("words",), "SELECT DISTINCT lang AS source, word FROM words"),
    "dictionary": (("source_words",), """
      SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY word) - 1 AS pos FROM source_words"""),
    "wide_words": (("words",), f"""
      SELECT doc_id, page_no, tag, word, 14::bigint AS h, 10*length(word)*(1+{h("concat('w|',tag)")}%40) AS w FROM words"""),
    "charset": (("words",), """
      SELECT string_agg(c, '' ORDER BY c) AS cs, count(*) AS n FROM (SELECT DISTINCT unnest(string_split(word, '')) AS c FROM words)"""),
    "char_scores": (("words", "charset"), f"""
      SELECT tag, word, list_transform(steps, lambda k: list_transform(range(0,n+1), lambda j: CASE WHEN j = k THEN 0.9::double ELSE 0.01::double END)) AS scores
      FROM (SELECT tag, word, flatten(list_transform(range(1, length(word)+1), lambda i: list_concat(
              CASE WHEN i > 1 AND word[i] = word[i-1] THEN [n::bigint] ELSE []::bigint[] END,
              CASE WHEN {h("concat('q|',tag,'|',i-1)")} % 2 = 0 THEN [(strpos(cs, word[i])-1)::bigint]
                   ELSE [(strpos(cs, word[i])-1)::bigint,(strpos(cs, word[i])-1)::bigint] END))) AS steps, n
            FROM words, charset)"""),
    "script_scores": (("words",), f"""
      SELECT *, ({h("concat('x|',tag,'|',script)")}%100)/100.0::double AS score FROM (
        SELECT doc_id, page_no, tag, unnest(['latin','german','french','spanish']) AS script FROM words)"""),
    "batches": ((), f"""
      SELECT event_type AS run, date_diff('day', date '2024-01-01', ts::date) AS epoch, event_id AS batch, value AS loss,
             1 + {h("concat('n|',event_id)")}%8 AS n FROM events"""),
    "epochs": ((), """
      SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS epoch,
             value AS val_loss, value*0.9 AS train_loss FROM events"""),
    "page_paths": ((), f"""
      SELECT page_id, regexp_extract(host, '([a-z]+)$', 1) AS kind,
        concat(CASE WHEN {h("concat('y|',page_id)")}%3 = 0 THEN '' ELSE concat(host,'/') END,
        CASE {h("concat('k|',page_id)")}%6 WHEN 0 THEN 'index.html' WHEN 1 THEN 'index.htm' WHEN 2 THEN 'about.html'
          WHEN 3 THEN 'a/index.html' WHEN 4 THEN 'a/b/c/index.html' ELSE 'logo.png' END) AS path
      FROM (SELECT page_id, regexp_extract(regexp_replace(url,'^https?://',''), '^([^/?#]*)', 1) AS host FROM pages)"""),
    "link_graph": ((), """
      SELECT page_id AS src, (page_id*7 + k*13 + 1) % (SELECT count(*) FROM pages) AS dst, k
      FROM pages, (SELECT unnest(range(0,5)) AS k)"""),
    "link_list": ((), """
      SELECT page_id AS pos, url FROM pages
      UNION ALL SELECT page_id + (SELECT count(*) FROM pages), url FROM pages WHERE page_id % 10 = 0"""),
    "used": ((), f"SELECT url FROM pages WHERE {h('''concat('u|',url)''')} % 3 = 0"),
    "recognised": (("words",), f"""
      SELECT doc_id, page_no, row_no, tag, target, CASE WHEN x % 11 = 0 THEN replace(cut,'e','c') ELSE cut END AS predicted
      FROM (SELECT *, CASE WHEN x % 7 = 0 THEN substr(target,1,length(target)-1) ELSE target END AS cut
            FROM (SELECT doc_id, page_no, row_no, tag, word AS target, {h("concat('p|',tag)")} AS x FROM words))"""),
    "html_text": ((), f"SELECT page_id, {clean_html('html')} AS text FROM pages"),
}


def with_tables(body: str, *names: str, recursive: bool = False, extra: str = "") -> str:
    """The body behind a WITH clause of the named tables and all they need."""
    done: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in done]
    if extra:
        parts.append(extra)
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
