"""Given tables as operator inputs.

Expressions in capitals are plain SQL that Spark and DuckDB read alike, so both sides of a check
start from the same input; everything after the input is written separately for each engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanflow.contract import RunContext
from gleanflow.operators.layout import spread, spread_rows

RUN = RunContext(run_id="run_fixed", trigger="schedule", now="2024-02-01T03:00:00.000Z")

NL = "chr(10)"

# --- repository view of documents ----------------------------------------------------

PATH = (
    "(CASE WHEN coalesce(toxic, 0) = 1 THEN 'content-old/' ELSE 'content/' END || lang || ' Notes/' "
    "|| CAST(doc_id AS VARCHAR(20)) || '_' || lang || "
    "CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.MDOC' WHEN 'de' THEN '.mdoc' ELSE '.txt' END)"
)
KIND = "(CASE WHEN lang = 'de' AND n_chars < 400 THEN 'tree' ELSE 'blob' END)"
HEADER_REF = "(CASE source WHEN 'src1' THEN 'old-branch' ELSE 'main' END)"
HEADER_DIR = "(CASE source WHEN 'src2' THEN 'posts' ELSE 'content' END)"
HEADER_TRACKED = "(source <> 'src4')"

# --- front matter put before document texts -------------------------------------------

_FLAT = (
    "'title: Notes of ' || source || ' # draft' || {nl} || 'chars: ' || CAST(n_chars AS VARCHAR(20)) || {nl}"
    " || 'ratio: ' || CAST(n_chars AS VARCHAR(20)) || '.50' || {nl} || 'draft: True' || {nl} || 'empty:' || {nl}"
    " || '# comment' || {nl} || 'quoted: \"a: b # c\"' || {nl}"
    " || 'link: https://example.com/' || CAST(doc_id AS VARCHAR(20)) || '#top' || {nl} || 'date: 2024-01-05'"
)
_LISTS = (
    "'tags:' || {nl} || '  - fr' || {nl} || '  - ' || source || {nl} || '  - fr' || {nl}"
    " || 'tag: [' || source || ', \"x, y\", 7]' || {nl} || 'meta: {{a: 1, b: two}}' || {nl}"
    " || 'title: ''it''''s ' || CAST(doc_id AS VARCHAR(20)) || ''''"
)
_NESTED = (
    "'author:' || {nl} || '  name: Ada' || {nl} || '  links:' || {nl}"
    " || '    site: https://e.example/' || CAST(doc_id AS VARCHAR(20)) || {nl}"
    " || 'authors:' || {nl} || '- name: X' || {nl} || '  url: u' || {nl} || '- name: Y' || {nl}"
    " || 'summary: |' || {nl} || '  line one' || {nl} || '    deeper' || {nl} || '  # literal' || {nl}"
    " || 'folded: >-' || {nl} || '  a' || {nl} || '  b' || {nl} || {nl} || '  c' || {nl} || 'last: ~'"
)
_BROKEN = (
    "CASE source WHEN 'src0' THEN 'title: A' || {nl} || chr(9) || 'tabbed: B'"
    " WHEN 'src1' THEN 'base: &anchor value' WHEN 'src2' THEN '<<: other'"
    " WHEN 'src3' THEN 'title: A' || {nl} || 'just text' WHEN 'src4' THEN '- one' || {nl} || '- two'"
    " WHEN 'src5' THEN 'tags: [a, b' WHEN 'src6' THEN 'meta: {{a}}'"
    " WHEN 'src7' THEN 'title: A' || {nl} || '  stray: B' WHEN 'src8' THEN '? complex'"
    " ELSE 'title: A' || {nl} || '...' END"
)
BLOCK = (
    "(CASE lang WHEN 'en' THEN " + _FLAT + " WHEN 'fr' THEN " + _LISTS + " WHEN 'de' THEN " + _NESTED
    + " ELSE " + _BROKEN + " END)"
).format(nl=NL)
FRONT_TEXT = f"('---' || {NL} || {BLOCK} || {NL} || '---' || {NL} || text)"
GOOD_TEXT = f"(CASE WHEN lang = 'es' THEN text ELSE {FRONT_TEXT} END)"

# --- outbox log view of events ----------------------------------------------------------

EVENT = (
    "(CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'purchase' THEN 'sent' WHEN 'error' THEN 'failed'"
    " WHEN 'click' THEN 'pending' ELSE CASE WHEN value < 15 THEN 'enqueue' ELSE 'remove' END END)"
)
EVENT_ERROR = "(CASE WHEN event_type = 'error' THEN 'failed with ' || props END)"

# --- JSON texts derived from events -------------------------------------------------------

_V = "CAST(user_id AS VARCHAR(20))"
OPTIONS_JSON = (
    "(CASE event_type"
    f" WHEN 'signup' THEN '{{\"repository_url\":\"https://github.com/o/r' || {_V} || '\",\"branch\":\"main\",\"allow_cloud_llm\":true}}'"
    f" WHEN 'error' THEN '{{\"branchh\":' || {_V} || ',\"token_env\":null}}'"
    f" WHEN 'click' THEN '{{\"repository_url\":' || {_V} || ',\"allow_cloud_llm\":\"yes\",\"props\":' || props || '}}'"
    f" WHEN 'view' THEN '{{\"repository_url\":\"no-uri-' || {_V} || '\",\"privacy_level\":\"secret\",\"zzz_unrelated\":1}}'"
    f" ELSE props END)"
)
CAPTURE_JSON = (
    "(CASE event_type"
    " WHEN 'signup' THEN '{\"schema_version\":\"capture.v1\",\"id\":\"c' || " + _V + " || '\",\"connector\":\"x\",\"observed_at\":\"t\",\"captured_at\":\"t\","
    "\"subject\":{\"kind\":\"web\",\"uri\":\"u' || " + _V + " || '\",\"title\":null,\"url\":null},\"payload\":{\"kind\":\"text\",\"text\":\"p\"},\"tags\":[\"a\"],"
    "\"metadata\":' || props || ',\"privacy\":{\"level\":\"public\",\"allow_cloud_llm\":false},\"provenance\":{\"trigger\":\"import\",\"connector_version\":\"x@1\"}}'"
    " WHEN 'error' THEN '{\"schema_version\":\"other\",\"id\":\"c' || " + _V + " || '\"}'"
    " WHEN 'click' THEN '{\"capture\":{\"schema_version\":\"capture.v1\",\"id\":\"e' || " + _V + " || '\",\"connector\":\"x\",\"observed_at\":\"t\",\"captured_at\":\"t\","
    "\"subject\":{\"kind\":\"url\",\"uri\":\"u' || " + _V + " || '\"},\"payload\":{\"kind\":\"reference\"},\"tags\":[],"
    "\"metadata\":{},\"privacy\":{\"level\":\"sensitive\",\"allow_cloud_llm\":true},\"provenance\":{\"trigger\":\"manual\",\"connector_version\":\"x@1\"}},\"outbox\":' || props || '}'"
    " WHEN 'view' THEN '{\"schema_version\":\"capture.v1\",\"id\":\"c' || " + _V + " || '\",\"connector\":\"x\",\"observed_at\":\"t\",\"captured_at\":\"t\","
    "\"subject\":{\"kind\":\"web\",\"uri\":\"u\"},\"payload\":{\"kind\":\"text\"},\"tags\":[\"a\",' || " + _V + " || '],\"metadata\":{},\"privacy\":{\"level\":\"public\"}}'"
    " ELSE replace(props, '}', '') END)"
)
INSTANCE_JSON = (
    "(CASE event_type"
    f" WHEN 'signup' THEN '{{\"id\":\" i' || {_V} || ' \",\"connector\":\"web-page\"}}'"
    f" WHEN 'error' THEN '{{\"connector\":\"x\",\"config\":' || props || '}}'"
    f" WHEN 'click' THEN '{{\"id\":\"i' || {_V} || '\",\"connector\":\"x\",\"enabled\":\"yes\"}}'"
    f" WHEN 'view' THEN '{{\"id\":\"i' || {_V} || '\",\"connector\":\"y\",\"enabled\":false,\"schedule\":\"0 3 * * *\",\"config\":' || props || ',\"checkpoint\":null}}'"
    f" ELSE '{{\"id\":\"i' || {_V} || '\",\"connector\":\"x\",\"config\":[]}}' END)"
)
TARGET_JSON = (
    "(CASE event_type"
    f" WHEN 'signup' THEN '{{\"id\":\"t' || {_V} || '\",\"kind\":\"file\",\"config\":{{\"directory\":\" out/' || {_V} || '\",\"include_privacy_levels\":[]}}}}'"
    f" WHEN 'error' THEN '{{\"id\":\"t' || {_V} || '\",\"kind\":\"ftp\"}}'"
    f" WHEN 'click' THEN '{{\"id\":\"t' || {_V} || '\",\"kind\":\"webhook\",\"config\":{{\"url\":\"https://h.example/' || {_V} || '\",\"timeout_ms\":' || {_V} || ',\"include_privacy_levels\":[\"sensitive\",\"odd\"]}}}}'"
    f" WHEN 'view' THEN '{{\"id\":\"t' || {_V} || '\",\"kind\":\"webhook\",\"config\":' || props || '}}'"
    f" ELSE '{{\"id\":\"t' || {_V} || '\",\"kind\":\"webhook\",\"config\":{{\"url\":\"http://h.example\"}}}}' END)"
)

# Hosts as they may be written, their usual form (none: refused) and the reason of a refusal.
HOSTS = (
    ("BÜCHER.example", "xn--bcher-kva.example", None), ("日本語。jp", "xn--wgv71a119e.jp", None), ("straße.de:8080", "xn--strae-oqa.de:8080", None),
    ("пример.испытание", "xn--e1afmkfd.xn--80akhbyknj4f", None), ("παράδειγμα.gr", "xn--hxajbheg2az3al.gr", None), ("한국.kr", "xn--3e0b707e.kr", None),
    ("☃.net", None, "internationalized host"), ("ﬁn.example", None, "internationalized host"), ("0x7f.1", "127.0.0.1", None), ("017700000001", "127.0.0.1", None),
    ("256.1.1.1", None, "invalid host"), ("[2001:DB8:0:0:0:0:0:1]", "[2001:db8::1]", None), ("[::ffff:1.2.3.4]", "[::ffff:102:304]", None), ("[1:2]", None, "invalid host"),
    ("a%41.example", "aa.example", None), ("user@Example.COM", "user@example.com", None), ("a b.example", None, "invalid host"), ("x.example:65536", None, "invalid port"),
)


def host_cases(page: str = "page_id", column: int = 0) -> str:
    """A ``CASE`` that picks a host for each page."""
    cells = [h[column] for h in HOSTS]
    whens = " ".join(f"WHEN {i} THEN " + ("NULL" if c is None else "'" + c + "'") for i, c in enumerate(cells))
    return f"(CASE {page} % {len(HOSTS)} {whens} END)"


# Configs that keep and break the other rule sets, from every turn of every conversation.
_C, _T = "CAST(conv_id AS VARCHAR(20))", "CAST(turn AS VARCHAR(20))"
PAGE_CONFIG = (
    f"('{{\"url\":\"' || CASE WHEN turn % 2 = 0 THEN 'https://x.example/' ELSE 'no uri ' END || {_C} || '\",\"tags\":[\"' || role || '\",' || {_T} || ',null],"
    f"\"privacy_level\":\"' || CASE role WHEN 'user' THEN 'public' ELSE role END || '\",\"titel\":' || {_T} || '}}')"
)
FILE_CONFIG = (
    "('{\"directory\":\"' || CASE WHEN turn = 0 THEN '' ELSE role END || '\",\"include_privacy_levels\":[\"public\",\"' || role || '\"]}')"
)
HOOK_CONFIG = (
    f"('{{' || CASE WHEN turn % 3 = 0 THEN '' ELSE '\"url\":\"https://h.example/' || {_C} || '\",' END || '\"timeout_ms\":' || {_T} || CASE WHEN turn % 2 = 0 THEN '.0' ELSE '.5' END"
    f" || ',\"headers\":' || CASE role WHEN 'user' THEN '{{\"x\":1}}' ELSE '[' || {_T} || ']' END || '}}')"
)
LIST_CONFIG = (
    f"('{{\"parts\":[' || CASE WHEN turn = 0 THEN '' WHEN turn = 1 THEN '{{\"name\":\"' || role || '\"}}' ELSE '{{\"name\":\"a\"}},{{\"size\":' || {_T} || '}}' END || ']}}')"
)
LIST_RULES = {
    "type": "object",
    "properties": {
        "parts": {
            "type": "array",
            "minItems": 2,
            "items": {"type": "object", "required": ["name"], "additionalProperties": False, "properties": {"name": {"type": "string", "minLength": 5}}},
        }
    },
}

# --- repository settings derived from documents --------------------------------------------

REPOSITORY = (
    "(CASE lang WHEN 'en' THEN 'https://github.com/' || source || '/repo' || CAST(doc_id AS VARCHAR(20)) || '.git'"
    " WHEN 'fr' THEN ' https://www.github.com/' || source || '/r/tree/v' || CAST(doc_id AS VARCHAR(20)) || '/docs/fr/ '"
    " WHEN 'de' THEN 'https://github.com/' || source || '/r/issues'"
    " ELSE 'https://gitlab.com/' || source || '/r' END)"
)
BRANCH = "(CASE WHEN n_chars < 500 THEN ' dev ' END)"
CONTENT_DIR = "(CASE source WHEN 'src0' THEN '/a/../b' WHEN 'src1' THEN ' /posts/ ' END)"
DEFAULT_BRANCH = "(CASE WHEN source <> 'src3' THEN 'trunk' END)"

# --- crawl responses derived from events ------------------------------------------------------

RESPONSE_URL = "('https://api.example.com/items/' || CAST(event_id AS VARCHAR(20)))"
RESPONSE_STATUS = (
    "(CASE event_type WHEN 'signup' THEN 200 WHEN 'error' THEN CASE WHEN value < 10 THEN 403 ELSE 429 END"
    " WHEN 'click' THEN CASE WHEN value < 10 THEN 401 ELSE 404 END"
    " WHEN 'view' THEN CASE WHEN value < 10 THEN 503 ELSE 200 END END)"
)
RESPONSE_BODY = "(CASE WHEN event_type = 'view' THEN '  oops ' || props || ' ' ELSE props END)"
ERROR_NAME = (
    "(CASE WHEN event_type = 'purchase' THEN CASE WHEN value < 10 THEN 'TimeoutError' ELSE 'TypeError' END END)"
)
REMAINING = "(CASE WHEN event_type = 'error' AND value < 20 THEN '0' END)"
RESET = "(CASE WHEN value < 5 THEN '0' WHEN value < 8 THEN '1900000000' END)"


# --- Spark frames --------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(
        "page_id",
        "url",
        F.lit(200).alias("status"),
        F.lit("text/html").alias("content_type"),
        F.col("html").alias("body"),
        F.lit("pages").alias("instance_id"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_rows(table(spark, sf_dir, "events"), "event_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")


def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select(
        F.col("source").alias("instance_id"),
        F.expr(PATH).alias("path"),
        F.expr(KIND).alias("type"),
        F.sha2(F.expr(GOOD_TEXT), 256).alias("sha"),
        "quality",
        "toxic",
    )


def repository_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository_files(spark, sf_dir).select("instance_id", "path", "type", "sha")


def repository_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = repository_files(spark, sf_dir)
    return files.groupBy("instance_id").agg(F.max("sha").alias("tree_sha")).select(
        "instance_id",
        F.lit("octo").alias("owner"),
        F.col("instance_id").alias("repo"),
        F.lit("main").alias("ref"),
        F.lit("content").alias("content_dir"),
        "tree_sha",
        F.lit(False).alias("truncated"),
        F.lit("https://site.example/").alias("site_url"),
        F.lit(None).cast("string").alias("source_name"),
        F.lit(None).cast("string").alias("privacy_level"),
        F.lit(None).cast("boolean").alias("allow_cloud_llm"),
    )


def checkpoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Former state: labelled documents, with another hash where quality is 0, none where also toxic."""
    known = repository_files(spark, sf_dir).where(F.col("quality").isNotNull())
    return known.select(
        "instance_id",
        "path",
        F.when(F.col("quality") == 1, F.col("sha"))
        .when(F.col("toxic") == 0, F.sha2(F.concat(F.lit("old"), F.col("sha")), 256))
        .alias("sha"),
    )


def checkpoint_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = repository_files(spark, sf_dir).where(F.col("quality").isNotNull())
    tops = known.groupBy(F.col("instance_id").alias("source")).agg(
        F.max("sha").alias("tree_sha"), F.count("*").alias("file_count")
    )
    return tops.select(
        F.col("source").alias("instance_id"),
        F.concat(F.lit("https://github.com/octo/"), F.col("source")).alias("repository"),
        F.expr(HEADER_REF).alias("ref"),
        F.expr(HEADER_DIR).alias("content_dir"),
        "tree_sha",
        F.expr(HEADER_TRACKED).alias("files_tracked"),
        "file_count",
        F.lit(0).cast("bigint").alias("changed"),
        F.lit("2024-01-31T03:00:00.000Z").alias("scanned_at"),
    )


def front_documents(spark: SparkSession, sf_dir: str, text: str = FRONT_TEXT) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "lang", "source", F.expr(text).alias("text"))


def repository_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs of all documents with readable front matter, one per content."""
    return (
        documents(spark, sf_dir)
        .select(F.expr(GOOD_TEXT).alias("content"))
        .groupBy(F.sha2("content", 256).alias("sha"))
        .agg(F.min("content").alias("content"))
        .select("sha", F.lit("base64").alias("encoding"), F.base64(F.encode("content", "UTF-8")).alias("content"))
    )


def document_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("toxic") == 1, "sensitive").when(F.col("quality") == 1, "public").otherwise("private")
    return labelled(spark, sf_dir).select(
        "doc_id",
        F.concat(F.lit("text://manual/"), F.sha2("text", 256)).alias("uri"),
        "text",
        F.array("lang").alias("tags"),
        level.alias("privacy_level"),
        (F.col("quality") == 1).alias("stored"),
    )


def outbox_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"),
        F.expr(EVENT).alias("event"),
        F.expr(EVENT_ERROR).alias("error"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"),
        F.lit(None).cast("string").alias("target"),
    )
