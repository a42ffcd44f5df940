"""Queries that make mirrors of documents and pages, and check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import identify as D
from corpusloom.operators import mirror as M
from corpusloom.sources.html import html_text

#: lines of a page
PAGE_LINES = 5


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, name and content: documents as text files."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.concat(F.lit("Doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"), "text", "source")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number and text: five lines of a document are a page."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", "\n").alias("l"))
    n = F.ceil(F.size("l") / PAGE_LINES).cast("int")
    pages = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice("l", i * PAGE_LINES + 1, PAGE_LINES), "\n"))
    return d.select("doc_id", F.posexplode(pages).alias("number", "text")).select("doc_id", (F.col("number") + 1).alias("number"), "text")


_PAGES = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, CAST((i - 1) // 5 + 1 AS INTEGER) AS number, string_agg(x, chr(10) ORDER BY i) AS text FROM l GROUP BY 1, 2)"""


def flagship_mirror_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirror each document, read it back and verify it: hash, size, title, words and problems."""
    m = M.text_mirror(files(spark, sf_dir))
    again = F.regexp_replace(F.regexp_replace("body", "^# [^\\n]*\\n\\n", ""), "\\n$", "")
    ok = T.single_spaced(again) == T.single_spaced(F.col("text"))  # the same words
    return m.select("doc_id", "content_hash", "byte_size", "outcome", T.title_from_name(F.col("name")).alias("title"), F.length("body").alias("body_length"), T.count_words(F.col("body")).alias("n_words"), F.array_join("verify", ",").alias("flags"), F.when(ok, "").otherwise("words-changed").alias("problems"))


def str01_slug_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", T.slugify(F.col("text")).alias("slug"))


def str02_title_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", T.title_from_name(F.col("name")).alias("title"))


def str03_newlines_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with CRLF for every second line end, normalised."""
    t = F.replace(F.replace("text", F.lit(".\n"), F.lit(".\r\n")), F.lit(",\n"), F.lit(",\r"))
    return files(spark, sf_dir).select("doc_id", F.sha2(T.body_text(t), 256).alias("digest"), F.length(T.body_text(t)).alias("n"))


def str06_sections_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the body that pages make, with the number of characters of each."""
    b = _pages(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("p"))  # pages of one document
    body = M.page_body(F.transform("p", lambda x: x["text"]))
    return b.select("doc_id", F.posexplode(M.sections(body)).alias("ordinal", "s")).select("doc_id", "ordinal", F.col("s.heading").alias("heading"), F.length("s.text").alias("n"))


def str11_words_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", T.count_words(F.col("text")).alias("n_words"), T.count_words(F.col("text"), inline=True).alias("n_inline"))


def str09_fence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", T.fence(F.replace("text", F.lit("*"), F.lit("`"))).alias("fence"), T.cell(F.col("text")).alias("cell"))


def str19_tidy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", T.tidy(F.col("text"), 40).alias("tidy"))


def hsh01_hash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select("doc_id", T.content_hash(F.col("content")).alias("content_hash"), F.octet_length("content").alias("byte_size"), T.anchor(T.content_hash(F.col("content")), F.lit(7)).alias("anchor"))


def set06_duplicate_bytes_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests that several documents have, with how many and the first."""
    f = files(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("digest"))
    return f.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def src08_text_flags_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document with a NUL, every fifth with a byte that isn't UTF-8: outcome and flags."""
    f = files(spark, sf_dir)
    bad = F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.unhex(F.lit("00")))).when(F.col("doc_id") % 5 == 0, F.concat("content", F.unhex(F.lit("FF")))).otherwise(F.col("content"))
    m = M.text_mirror(f.withColumn("content", bad))
    return m.select("doc_id", "outcome", F.array_join("verify", ",").alias("flags"), "byte_size", D.exit_code(F.col("outcome")).alias("exit_code"))


def src10_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", html_text(F.col("html")).alias("text"))


def str05_page_body_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _pages(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("p"))  # pages of one document
    return b.select("doc_id", F.sha2(M.page_body(F.transform("p", lambda x: x["text"])), 256).alias("digest"))


def win03_page_map_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.page_map(_pages(spark, sf_dir), ["doc_id"], "number", "text").select("doc_id", "number", "start", "end_")


def val03_map_verify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page maps with every eleventh document's ends moved by one: what the check finds."""
    pages = M.page_map(_pages(spark, sf_dir), ["doc_id"], "number", "text").withColumn("end_", F.when(F.col("doc_id") % 11 == 0, F.col("end_") + 1).otherwise(F.col("end_")))
    body = _pages(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("p")).select("doc_id", M.page_body(F.transform("p", lambda x: x["text"])).alias("body"))
    return M.map_problems(pages.join(body, "doc_id"), ["doc_id"], "number", "body", "text").where("problems <> ''")


def flt08_page_select_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for recognition: without text, or with half of them covered by raster (here from the number of characters)."""
    p = _pages(spark, sf_dir)
    return p.withColumn("coverage", F.length("text") % 100 / 100.0).where((F.trim("text") == "") | (F.col("coverage") >= 0.5)).select("doc_id", "number", "coverage")


def jon01_native_recovered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered text of every third page takes the place of the native one; counts must agree."""
    p = _pages(spark, sf_dir)
    r = p.where("number % 3 = 0").select(F.col("doc_id").alias("d"), F.col("number").alias("k"), F.concat(F.reverse("text"), F.lit("!")).alias("recovered"))
    j = p.join(r, (F.col("doc_id") == F.col("d")) & (F.col("number") == F.col("k")), "left")
    return j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count("recovered").alias("n_recovered"), F.sum(F.length(F.coalesce("recovered", "text"))).alias("n_chars"), (F.max("number") == F.count(F.lit(1))).alias("complete"))


def flt09_native_pages_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    ocr = p.where("number % 3 = 0").select("doc_id", "number")
    return p.join(ocr, ["doc_id", "number"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_native"))


def jon21_verify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrors against sources of which every ninth changed and every tenth is gone."""
    f = files(spark, sf_dir)
    now = f.where("doc_id % 10 <> 0").withColumn("content", F.when(F.col("doc_id") % 9 == 0, F.concat("content", F.lit(b"!"))).otherwise(F.col("content")))
    return M.verified(M.text_mirror(f), now, "doc_id").where("problems <> ''")


def snk03_names_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("source"), F.lit(".pdf"))).otherwise(F.concat(F.col("source"), F.lit(".txt"))).alias("name"))
    t = f.select(M.target_name(F.col("name"), F.when(F.col("name").endswith(".pdf"), "application/pdf")).alias("target"))
    return t.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def jon15_manifest_diff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents against a later state: every seventh gone, every fifth altered, every third with another mode, some new."""
    b = files(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("digest"), F.lit("100644").alias("mode"))
    kept = b.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(F.col("digest")).alias("digest"), F.when(F.col("doc_id") % 3 == 0, "100755").otherwise(F.col("mode")).alias("mode"))
    new = b.where("doc_id % 50 = 0").select((F.col("doc_id") + 100_000_000).alias("doc_id"), "digest", "mode")
    return M.diff(b, kept.union(new), "doc_id", "digest", "mode")


def flt01_sniff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind the magic of several kinds of files, identified and routed."""
    heads = F.array(F.lit(""), F.lit("255044462D"), F.lit("504B0304"), F.lit("89504E470D0A1A0A"), F.lit("0001"), F.lit("0A0A255044462D"))
    f = files(spark, sf_dir).select("doc_id", F.concat(F.unhex(F.element_at(heads, (F.col("doc_id") % 6).cast("int") + 1)), F.col("content")).alias("content"))
    k = f.select("doc_id", D.sniffed(F.col("content")).alias("k"))
    return k.select("doc_id", F.col("k.media_type").alias("media_type"), F.array_join("k.flags", ",").alias("flags"), D.supported(F.col("k.media_type")).alias("supported"))


def flt05_mail_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth document is a message, every fourth has too few headers: what it is taken for."""
    head = F.when(F.col("doc_id") % 4 == 0, "From: a@b\nTo: c@d\nSubject: x\n y\n\n").when(F.col("doc_id") % 4 == 1, "From: a@b\nTo: c@d\n\n").otherwise("")
    f = files(spark, sf_dir).select("doc_id", F.concat(head, F.col("text")).alias("t"))
    return f.select("doc_id", D.refined(F.lit("text/plain"), F.col("t")).alias("media_type"))


def flt06_outcomes_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(F.lit("ok"), F.lit("password-required"), F.lit("zero-page"), F.lit("malformed-pdf")), (F.col("doc_id") % 4).cast("int") + 1)
    f = files(spark, sf_dir).select("doc_id", code.alias("code"))
    return f.select("doc_id", "code", D.outcome(F.col("code")).alias("outcome"), D.exit_code(D.outcome(F.col("code"))).alias("exit_code"))


def set01_flags_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array_compact(F.array(F.when(F.col("doc_id") % 2 == 0, "ocr-pending"), F.when(F.col("doc_id") % 3 == 0, "media-type-unknown")))
    b = F.array_compact(F.array(F.when(F.col("doc_id") % 4 == 0, "ocr-pending"), F.when(F.col("doc_id") % 5 == 0, "binary-content")))
    return files(spark, sf_dir).select("doc_id", F.array_join(M.merged_flags(a, b), ",").alias("flags"))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] != "_" and callable(f) and getattr(f, "__module__", "") == __name__ and name not in ("files",)}

_MIRROR = r"""WITH f AS (SELECT *, 'Doc_' || doc_id || '.' || lang || '.txt' AS name, 'Doc ' || doc_id || ' ' || upper(lang[1]) || lang[2:] AS title FROM documents)"""
_SYNTAX = r"regexp_replace({0}, '(?m)^(?:#{{1,6}} |- |> )', '', 'g')"
_W = lambda x: f"len(list_filter(regexp_split_to_array({x}, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: w <> ''))"

ORACLES = {
    "flagship_mirror_documents": f"""{_MIRROR}, b AS (SELECT *, '# ' || title || chr(10) || chr(10) || rtrim(ltrim(text, chr(10)), chr(10)) || chr(10) AS body, contains(hex(encode(text)), '00') AND regexp_matches(hex(encode(text)), '^(..)*00') AS nul FROM f),
      w AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(body, '^# [^\\n]*\\n\\n', ''), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '') = list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '') AS same FROM b)
      SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, strlen(text) AS byte_size, CASE WHEN nul THEN 'deferred' ELSE 'processable' END AS outcome, title, CAST(length(body) AS INTEGER) AS body_length,
      {_W(_SYNTAX.format("body"))} AS n_words, CASE WHEN nul THEN 'binary-content' ELSE '' END AS flags, CASE WHEN same THEN '' ELSE 'words-changed' END AS problems FROM w""",
    "str01_slug_documents": "SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'document') AS slug FROM documents",
    "str02_title_documents": f"{_MIRROR} SELECT doc_id, title FROM f",
    "str03_newlines_documents": "SELECT doc_id, sha256(text) AS digest, length(text) AS n FROM documents",
    "str06_sections_documents": f"{_PAGES} SELECT doc_id, CAST(number - 1 AS INTEGER) AS ordinal, 'Page ' || number AS heading, length(CASE WHEN trim(text) = '' THEN '[no text on this page]' ELSE trim(text, chr(10)) END) AS n FROM p",
    "str11_words_documents": f"""SELECT doc_id, {_W(_SYNTAX.format('text'))} AS n_words,
      len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({_SYNTAX.format('text')}, '\\]\\([^)]*\\)', ']', 'g'), '[*`|\\\\\\[\\]•▪◦‣]', '', 'g'), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: w <> '' AND NOT regexp_full_match(w, '[-:]+'))) AS n_inline FROM documents""",
    "str09_fence_documents": r"""SELECT doc_id, repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '[*`]+'), lambda x: length(x))), 0) + 1)) AS fence,
      trim(replace(replace(text, '|', '\|'), chr(10), ' ')) AS cell FROM documents""",
    "str19_tidy_documents": f"""SELECT doc_id, array_to_string(w[1:40], ' ') || CASE WHEN len(w) > 40 THEN ' […]' ELSE '' END AS tidy FROM (
      SELECT doc_id, list_filter(regexp_split_to_array({_SYNTAX.format('text')}, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: w <> '') AS w FROM documents)""",
    "hsh01_hash_documents": "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, CAST(strlen(text) AS INTEGER) AS byte_size, 'pdf-' || sha256(text) || '-page-000007' AS anchor FROM documents",
    "set06_duplicate_bytes_documents": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "src08_text_flags_documents": r"""WITH b AS (SELECT doc_id, encode(text) || CASE WHEN doc_id % 7 = 0 THEN '\x00'::BLOB WHEN doc_id % 5 = 0 THEN '\xFF'::BLOB ELSE ''::BLOB END AS c FROM documents),
      k AS (SELECT doc_id, octet_length(c) AS n, regexp_matches(hex(c), '^(..)*00') AS nul, regexp_matches(hex(c), '^(..)*(C0|C1|F[5-9A-F])') AS lossy FROM b)
      SELECT doc_id, CASE WHEN nul THEN 'deferred' ELSE 'processable' END AS outcome, CASE WHEN nul THEN 'binary-content' WHEN lossy THEN 'text-decode-lossy' ELSE '' END AS flags, n AS byte_size, CASE WHEN nul THEN 4 ELSE 0 END AS exit_code FROM k""",
    "src10_html_pages": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script\s*>', '', 'g') AS t FROM pages),
      b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?is)<style\b.*?</style\s*>', '', 'g'), '(?is)<head\b.*?</head\s*>', '', 'g') AS t FROM a),
      c AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(p|div|br|tr|li|h[1-6]|blockquote|table|ul|ol|hr)\b[^>]*>', chr(10), 'g'), '<[a-zA-Z/!][^>]*>', '', 'g') AS t FROM b),
      d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM c),
      e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f\v]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM d)
      SELECT page_id, trim(t, ' ' || chr(10)) AS text FROM e""",
    "str05_page_body_documents": f"{_PAGES} SELECT doc_id, sha256(string_agg('## Page ' || number || chr(10) || chr(10) || CASE WHEN trim(text) = '' THEN '[no text on this page]' ELSE text END, chr(10) || chr(10) ORDER BY number)) AS digest FROM p GROUP BY 1",
    "win03_page_map_documents": f"{_PAGES} SELECT doc_id, number, CAST(e - length(text) AS BIGINT) AS start, CAST(e AS BIGINT) AS end_ FROM (SELECT *, sum(length('## Page ' || number) + 2 + length(text) + CASE WHEN number > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY number ROWS UNBOUNDED PRECEDING) AS e FROM p)",
    "val03_map_verify_documents": f"""{_PAGES}, m AS (SELECT *, sum(length('## Page ' || number) + 2 + length(text) + CASE WHEN number > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY number ROWS UNBOUNDED PRECEDING) AS e FROM p),
      n AS (SELECT doc_id, number, text, e - length(text) AS start, e + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS end_, row_number() OVER (PARTITION BY doc_id ORDER BY number) AS place FROM m),
      b AS (SELECT doc_id, string_agg('## Page ' || number || chr(10) || chr(10) || CASE WHEN trim(text) = '' THEN '[no text on this page]' ELSE text END, chr(10) || chr(10) ORDER BY number) AS body FROM p GROUP BY 1),
      q AS (SELECT n.doc_id, number, concat_ws(',', CASE WHEN place <> number THEN 'ordinal' END, CASE WHEN start < lag(end_) OVER (PARTITION BY n.doc_id ORDER BY number) THEN 'overlap' END, CASE WHEN end_ < start THEN 'negative' END, CASE WHEN substr(body, CAST(start AS INTEGER) + 1, CAST(end_ - start AS INTEGER)) <> text THEN 'text' END) AS problems FROM n JOIN b ON b.doc_id = n.doc_id)
      SELECT * FROM q WHERE problems <> ''""",
    "flt08_page_select_documents": f"{_PAGES} SELECT doc_id, number, (length(text) % 100) / 100.0::DOUBLE AS coverage FROM p WHERE trim(text) = '' OR (length(text) % 100) / 100.0::DOUBLE >= 0.5",
    "jon01_native_recovered_documents": f"{_PAGES} SELECT doc_id, count(*) AS n_pages, count(*) FILTER (number % 3 = 0) AS n_recovered, CAST(sum(length(text || CASE WHEN number % 3 = 0 THEN '!' ELSE '' END)) AS BIGINT) AS n_chars, true AS complete FROM p GROUP BY 1",
    "flt09_native_pages_documents": f"{_PAGES} SELECT doc_id, count(*) AS n_native FROM p WHERE number % 3 <> 0 GROUP BY 1",
    "jon21_verify_documents": """WITH m AS (SELECT doc_id, sha256(text) AS h, strlen(text) AS n FROM documents), s AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 9 = 0 THEN '!' ELSE '' END) AS h, strlen(text) + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS n FROM documents WHERE doc_id % 10 <> 0),
      j AS (SELECT m.doc_id, concat_ws(',', CASE WHEN s.doc_id IS NULL THEN 'missing-source' END, CASE WHEN s.h <> m.h THEN 'hash' END, CASE WHEN s.n <> m.n THEN 'size' END) AS problems FROM m LEFT JOIN s ON s.doc_id = m.doc_id) SELECT * FROM j WHERE problems <> ''""",
    "snk03_names_documents": "SELECT source || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt.md' END AS target, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "jon15_manifest_diff_documents": """WITH b AS (SELECT doc_id, sha256(text) AS digest, '100644' AS mode FROM documents),
      a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE digest END AS digest, CASE WHEN doc_id % 3 = 0 THEN '100755' ELSE mode END AS mode FROM b WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id + 100000000, digest, mode FROM b WHERE doc_id % 50 = 0),
      j AS (SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'deleted' WHEN a.digest <> b.digest THEN 'modified' WHEN a.mode <> b.mode THEN 'mode-changed' END AS change FROM b FULL JOIN a ON a.doc_id = b.doc_id) SELECT * FROM j WHERE change IS NOT NULL""",
    "flt01_sniff_documents": r"""WITH b AS (SELECT doc_id, substr(hex(unhex(['', '255044462D', '504B0304', '89504E470D0A1A0A', '0001', '0A0A255044462D'][doc_id % 6 + 1]) || encode(text)), 1, 2048) AS x FROM documents),
      k AS (SELECT doc_id, CASE WHEN starts_with(x, '255044462D') THEN 'application/pdf' WHEN starts_with(x, '504B0304') THEN 'application/zip' WHEN starts_with(x, '89504E470D0A1A0A') THEN 'image/png' WHEN regexp_matches(x, '^(..)*255044462D') THEN 'application/pdf' WHEN NOT regexp_matches(x, '^(..)*00') THEN 'text/plain' END AS kind FROM b)
      SELECT doc_id, coalesce(kind, 'application/octet-stream') AS media_type, CASE WHEN kind IS NULL THEN 'media-type-unknown' ELSE '' END AS flags, coalesce(kind, '') NOT IN ('application/zip', '') AS supported FROM k""",
    "flt05_mail_documents": r"""WITH t AS (SELECT doc_id, string_split(substr(CASE doc_id % 4 WHEN 0 THEN 'From: a@b' || chr(10) || 'To: c@d' || chr(10) || 'Subject: x' || chr(10) || ' y' || chr(10) || chr(10) WHEN 1 THEN 'From: a@b' || chr(10) || 'To: c@d' || chr(10) || chr(10) ELSE '' END || text, 1, 8192), chr(10) || chr(10))[1] AS head FROM documents),
      l AS (SELECT doc_id, string_split(head, chr(10)) AS lines FROM t)
      SELECT doc_id, CASE WHEN len(list_filter(lines, lambda x: NOT contains(x, ':') AND NOT regexp_matches(x, '^[ \t]'))) = 0 AND len(list_intersect(list_transform(list_filter(lines, lambda x: contains(x, ':')), lambda x: lower(split_part(x, ':', 1))), ['from', 'to', 'subject', 'date', 'message-id', 'received', 'mime-version'])) >= 3 THEN 'message/rfc822' ELSE 'text/plain' END AS media_type FROM l""",
    "flt06_outcomes_documents": "SELECT doc_id, ['ok', 'password-required', 'zero-page', 'malformed-pdf'][doc_id % 4 + 1] AS code, ['processable', 'blocked', 'blocked', 'failed'][doc_id % 4 + 1] AS outcome, CAST([0, 3, 3, 5][doc_id % 4 + 1] AS INTEGER) AS exit_code FROM documents",
    "set01_flags_documents": """SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'ocr-pending' END, CASE WHEN doc_id % 3 = 0 THEN 'media-type-unknown' END], lambda x: x IS NOT NULL), list_filter([CASE WHEN doc_id % 4 = 0 THEN 'ocr-pending' END, CASE WHEN doc_id % 5 = 0 THEN 'binary-content' END], lambda x: x IS NOT NULL)))), ',') AS flags FROM documents""",
}
