"""Independent SQL for registered queries, written for DuckDB.

Inputs come from the shared mapping in ``fixtures``; the operators are written again in plain SQL.
Messages in it are fixed wording.
"""

from __future__ import annotations

from gleanflow.functions.text import BLANK_CODES, BLANKS
from gleanflow.plans import fixtures as fx

WS = "'" + BLANKS + "'"
WS_CLASS = "[" + "".join(rf"\x{{{code:X}}}" for code in BLANK_CODES) + "]"
NOW = fx.RUN.now


def _collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS_CLASS}+', ' ', 'g'))"


def _decode(text: str) -> str:
    for entity, char in (
        ("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"),
    ):
        text = f"regexp_replace({text}, '{entity}', {char}, 'gi')"
    return text


def _clean(text: str) -> str:
    return _collapse(_decode(f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"))


_NOISELESS = "html"
for _tag in ("script", "style", "noscript"):
    _NOISELESS = rf"regexp_replace({_NOISELESS}, '<{_tag}\b[^>]*>[\s\S]*?</{_tag}>', ' ', 'gi')"
PAGE_TEXT = _clean(_NOISELESS)
PAGE_TITLE = f"nullif({_clean(chr(39).join(['regexp_extract(html, ', r'(?i)<title[^>]*>([\s\S]*?)</title>', ', 1)']))}, '')"

# No page has dots in its path, credentials or ports, so the canonical form is short.
PAGE_URI = (
    "regexp_replace(regexp_replace(url, '#[\\s\\S]*$', ''), '^([a-z]+://[^/?]+)($|\\?)', '\\1/\\2')"
)
UTF16_LENGTH = (
    "(length(html) + len(regexp_extract_all(html, '[\\x{10000}-\\x{10FFFF}]')))"
)


def _json(text: str) -> str:
    return f"CAST(to_json({text}) AS VARCHAR)"


def _id(seed: str) -> str:
    return f"'cap_' || left(sha256({seed}), 20)"


def _source_seed(connector: str, instance: str, uri: str, content: str) -> str:
    return (
        f"'{{\"connector\":\"{connector}\",\"instance\":' || {_json(instance)} || ',\"uri\":' || {_json(uri)}"
        f" || ',\"contentHash\":\"sha256:' || sha256({content}) || '\"}}'"
    )


def _encode(text: str) -> str:
    encoded = f"url_encode({text})"
    for escape, char in (("%21", "!"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~"), ("%2F", "/")):
        encoded = f"replace({encoded}, '{escape}', '{char}')"
    return f"replace({encoded}, '%27', chr(39))"


WEB = f"""
SELECT {_id(_source_seed('web-page', "'pages'", 'uri', 'html'))} AS id, uri, coalesce(title, trim(url, {WS})) AS title,
  trim(url, {WS}) AS url, CASE WHEN text = '' THEN 'reference' ELSE 'text' END AS payload_kind,
  nullif(text, '') AS text, 'sha256:' || sha256(html) AS content_hash,
  '{{"status":200,"content_length":' || {UTF16_LENGTH} || '}}' AS metadata, 'private' AS level,
  'web-page@1.0.0' AS connector_version, '{NOW}' AS observed_at
FROM (SELECT url, html, {PAGE_URI} AS uri, {PAGE_TEXT} AS text, {PAGE_TITLE} AS title FROM pages)
"""

# --- repository view ---------------------------------------------------------------------

REPO = f"""
WITH files AS (
  SELECT d.doc_id, lang, source, n_chars, text, quality, toxic, source AS instance_id, {fx.PATH} AS path,
    {fx.KIND} AS type, {fx.GOOD_TEXT} AS content, sha256({fx.GOOD_TEXT}) AS sha
  FROM documents d LEFT JOIN labels USING (doc_id)),
sources AS (SELECT instance_id, max(sha) AS tree_sha FROM files GROUP BY 1),
listed AS (
  SELECT * FROM files WHERE type = 'blob' AND (path ILIKE '%.md' OR path ILIKE '%.mdoc')
    AND substr(path, 1, 8) = 'content/'),
headers AS (
  SELECT source AS instance_id, max(sha) AS tree_sha, {fx.HEADER_REF} AS ref, {fx.HEADER_DIR} AS dir,
    {fx.HEADER_TRACKED} AS tracked
  FROM files WHERE quality IS NOT NULL GROUP BY source),
usable AS (SELECT * FROM headers WHERE tracked AND ref = 'main' AND dir = 'content'),
before AS (
  SELECT instance_id, path, CASE WHEN quality = 1 THEN sha ELSE sha256('old' || sha) END AS sha
  FROM files WHERE quality IS NOT NULL AND (quality = 1 OR toxic = 0)
    AND instance_id IN (SELECT instance_id FROM usable)),
same AS (SELECT s.instance_id FROM sources s JOIN usable u ON u.instance_id = s.instance_id AND u.tree_sha = s.tree_sha),
changed AS (
  SELECT l.* FROM listed l LEFT JOIN before b ON b.instance_id = l.instance_id AND b.path = l.path
  WHERE l.instance_id NOT IN (SELECT instance_id FROM same) AND l.sha IS DISTINCT FROM b.sha)
"""

_CHECKPOINT = """
SELECT s.instance_id, {columns}, s.tree_sha,
  (SELECT count(*) FROM listed l WHERE l.instance_id = s.instance_id) AS file_count,
  (SELECT count(*) FROM {fresh} c WHERE c.instance_id = s.instance_id) AS changed
FROM sources s
"""

# --- captures of documents -------------------------------------------------------------------

_TEXT_ADDRESS = "'text://manual/' || sha256(text)"
DOC_CAPTURES = f"""
WITH captures AS (
  SELECT d.doc_id, quality, toxic, trim(text, {WS}) AS body,
    CASE WHEN toxic = 1 THEN 'sensitive' WHEN quality = 1 THEN 'public' ELSE 'private' END AS level,
    {_id("'{\"uri\":' || " + _json(_TEXT_ADDRESS) + " || ',\"note\":null,\"text\":' || " + _json(f"trim(text, {WS})")
         + " || ',\"title\":null,\"tags\":[' || " + _json('lang') + " || '],\"kind\":\"text\"}'")} AS id
  FROM documents d LEFT JOIN labels USING (doc_id)),
firsts AS (SELECT * FROM captures QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1)
"""
REASON = "'privacy level \"' || level || '\" is not accepted by this target'"
ATTEMPTS = f"""{DOC_CAPTURES}, outcomes AS (
  SELECT id, CASE WHEN right(id, 1) = '0' THEN 'failed' ELSE 'sent' END AS status,
    CASE WHEN right(id, 1) = '0' THEN 'Webhook responded HTTP 500' END AS error
  FROM firsts WHERE level <> 'sensitive')
"""

# --- outbox log ---------------------------------------------------------------------------------

LOG = f"""
WITH log AS (
  SELECT event_id AS seq, 'u' || user_id AS id, {fx.EVENT} AS event, {fx.EVENT_ERROR} AS error,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS moment FROM events),
lives AS (
  SELECT *, coalesce(sum((event = 'remove')::INT) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life
  FROM log),
placed AS (
  SELECT *, min(CASE WHEN event = 'enqueue' THEN seq END) OVER (PARTITION BY id, life) AS born,
    max(life) OVER (PARTITION BY id) + max((event = 'remove')::INT) FILTER (WHERE event = 'remove') OVER (PARTITION BY id, life) AS ended
  FROM lives),
entries AS (
  SELECT id,
    coalesce(arg_max(event, seq) FILTER (WHERE event IN ('sent','failed','pending') AND seq > born), 'pending') AS status,
    count(*) FILTER (WHERE event = 'failed' AND seq > born) AS attempts,
    (list(error ORDER BY seq DESC) FILTER (WHERE event IN ('sent','failed','pending') AND seq > born))[1] AS last_error,
    coalesce((list(moment ORDER BY seq DESC) FILTER (WHERE event IN ('sent','failed','pending') AND seq > born))[1], arg_min(moment, seq) FILTER (WHERE event = 'enqueue')) AS updated_at
  FROM placed GROUP BY id, life
  HAVING any_value(born) IS NOT NULL AND count(*) FILTER (WHERE event = 'remove') = 0)
"""

# --- front matter ---------------------------------------------------------------------------------

FRONT = f"WITH docs AS (SELECT doc_id, lang, source, n_chars, text, {fx.BLOCK} AS block FROM documents)"

_EN = [
    ("title", "'Notes of ' || source", "string", 1), ("chars", "n_chars::VARCHAR", "number", 2),
    ("ratio", "n_chars || '.5'", "number", 3), ("draft", "'true'", "boolean", 4), ("empty", "NULL", "null", 5),
    ("quoted", "'a: b # c'", "string", 7), ("link", "'https://example.com/' || doc_id || '#top'", "string", 8),
    ("date", "'2024-01-05'", "string", 9),
]
_FR = [
    ("tags[0]", "'fr'", "string", 2), ("tags[1]", "source", "string", 3), ("tags[2]", "'fr'", "string", 4),
    ("tag[0]", "source", "string", 5), ("tag[1]", "'x, y'", "string", 5), ("tag[2]", "'7'", "number", 5),
    ("meta.a", "'1'", "number", 6), ("meta.b", "'two'", "string", 6), ("title", "'it''s ' || doc_id", "string", 7),
]
_DE = [
    ("author.name", "'Ada'", "string", 2), ("author.links.site", "'https://e.example/' || doc_id", "string", 4),
    ("authors[0].name", "'X'", "string", 6), ("authors[0].url", "'u'", "string", 7), ("authors[1].name", "'Y'", "string", 8),
    ("summary", "'line one' || chr(10) || '  deeper' || chr(10) || '# literal'", "string", 9),
    ("folded", "'a b' || chr(10) || 'c'", "string", 13), ("last", "NULL", "null", 18),
]


def _leaves() -> str:
    parts = []
    for lang, leaves in (("en", _EN), ("fr", _FR), ("de", _DE)):
        for ordinal, (path, value, kind, line) in enumerate(leaves):
            parts.append(
                f"SELECT doc_id, '{path}' AS key_path, {ordinal}::BIGINT AS ordinal, {value} AS value, "
                f"'{kind}' AS value_type, {line}::BIGINT AS line FROM documents WHERE lang = '{lang}'"
            )
    return " UNION ALL ".join(parts)


FRONT_JSON = (
    "CASE lang WHEN 'en' THEN '{\"title\":\"Notes of ' || source || '\",\"chars\":' || n_chars || ',\"ratio\":' || n_chars || "
    "'.5,\"draft\":true,\"empty\":null,\"quoted\":\"a: b # c\",\"link\":\"https://example.com/' || doc_id || '#top\",\"date\":\"2024-01-05\"}'"
    " WHEN 'fr' THEN '{\"tags\":[\"fr\",\"' || source || '\",\"fr\"],\"tag\":[\"' || source || '\",\"x, y\",7],\"meta\":{\"a\":1,\"b\":\"two\"},\"title\":\"it''s ' || doc_id || '\"}'"
    " WHEN 'de' THEN '{\"author\":{\"name\":\"Ada\",\"links\":{\"site\":\"https://e.example/' || doc_id || '\"}},\"authors\":[{\"name\":\"X\",\"url\":\"u\"},{\"name\":\"Y\"}],"
    "\"summary\":\"line one\\n  deeper\\n# literal\",\"folded\":\"a b\\nc\",\"last\":null}' ELSE '{}' END"
)
FRONT_TAGS = "CASE lang WHEN 'fr' THEN source || '|x, y|fr' ELSE '' END"
# Comment of an unquoted line: everything from a hash at the start or after a blank.
_CONTENT = (
    "CASE WHEN raw LIKE 'quoted:%' THEN raw ELSE trim(regexp_replace(regexp_replace(raw, '^#.*$', ''), '[ \\t]#.*$', '')) END"
)

# --- JSON rules -----------------------------------------------------------------------------------------

_NAMES = (
    "repository_url", "branch", "content_dir", "site_url", "source_name", "token_env", "privacy_level", "allow_cloud_llm",
)


def _hint(key: str) -> str:
    ranked = ", ".join(
        f"{{'d': levenshtein({key}, '{name}'), 'p': {i}, 'n': '{name}'}}" for i, name in enumerate(_NAMES)
    )
    return (
        f"CASE WHEN list_min([{ranked}]).d <= greatest(2, length({key}) // 3) "
        f"THEN ' (did you mean \"' || list_min([{ranked}]).n || '\"?)' ELSE '' END"
    )


def _kind(value: str) -> str:
    return (
        f"CASE json_type({value}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' "
        f"WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'number' END"
    )


def _option_checks() -> str:
    checks = [
        "SELECT event_id, 'config.repository_url is required' AS error FROM c WHERE NOT list_contains(json_keys(config), 'repository_url')",
        f"SELECT event_id, 'config.' || key || ' is not a recognized option' || {_hint('key')} AS error "
        f"FROM (SELECT event_id, unnest(json_keys(config)) AS key FROM c) WHERE key NOT IN {_NAMES}",
    ]
    for name in _NAMES:
        value = f"json_extract(config, '$.{name}')"
        want = "boolean" if name == "allow_cloud_llm" else "string"
        has = f"list_contains(json_keys(config), '{name}')"
        if name == "privacy_level":
            checks.append(
                f"SELECT event_id, 'privacy_level must be one of \"public\", \"private\", \"sensitive\"' AS error FROM c WHERE {has} "
                f"AND (json_type({value}) <> 'VARCHAR' OR json_extract_string(config, '$.{name}') NOT IN ('public','private','sensitive'))"
            )
            continue
        checks.append(
            f"SELECT event_id, '{name} must be {want}, received ' || {_kind(value)} AS error FROM c WHERE {has} AND {_kind(value)} <> '{want}'"
        )
        if name in ("repository_url", "site_url"):
            checks.append(
                f"SELECT event_id, '{name} must be a valid absolute URI' AS error FROM c WHERE {has} AND {_kind(value)} = 'string' "
                f"AND NOT regexp_matches(json_extract_string(config, '$.{name}'), '^[A-Za-z][A-Za-z0-9+.-]*:')"
            )
    return " UNION ALL ".join(checks)


CAPTURE_PROBLEM = (
    "CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN 'Unsupported capture schema'"
    " WHEN 'click' THEN {click} WHEN 'view' THEN 'Capture tags must be an array of strings' ELSE 'not valid JSON' END"
)
_LOOKUP = "VALUES ('web-page', CAST(NULL AS VARCHAR)), ('repository-documents', '0 3 * * *')"
_OLD_NEW = """
WITH rows AS (SELECT 'i' || user_id AS id, event_type AS connector, props, event_id AS position FROM events),
old AS (SELECT * FROM rows WHERE connector IN ('signup', 'error')), new AS (SELECT * FROM rows WHERE connector NOT IN ('signup', 'error'))
"""

# Fixed value: the reason that the library gives.
BAD_HOST = "invalid host"

ORACLES: dict[str, str] = {
    "web_captures": WEB,
    "stream_captures": WEB,
    "page_text": f"SELECT page_id, {PAGE_TEXT} AS text FROM pages",
    "page_title": f"SELECT page_id, {PAGE_TITLE} AS title FROM pages",
    "canonical_urls": f"SELECT page_id, {PAGE_URI} AS uri, CAST(NULL AS VARCHAR) AS issue FROM pages",
    "page_hosts": f"SELECT page_id, 'http://' || {fx.host_cases(column=1)} || '/' || page_id || '?q' AS uri, {fx.host_cases(column=2)} AS issue FROM pages",
    "page_lengths": f"SELECT page_id, {UTF16_LENGTH} AS content_length FROM pages",
    "file_export": f"SELECT id, uri, text, {UTF16_LENGTH} AS content_length FROM (SELECT html, "
    f"{_id(_source_seed('web-page', chr(39) + 'pages' + chr(39), 'uri', 'html'))} AS id, uri, nullif(text, '') AS text "
    f"FROM (SELECT html, {PAGE_URI} AS uri, {PAGE_TEXT} AS text FROM pages))",
    "run_and_summary": f"SELECT count(*) AS total, count(*) AS pending, 0 AS sent, 0 AS failed FROM "
    f"(SELECT DISTINCT {PAGE_URI}, html FROM pages)",
    "stable_ids": f"SELECT doc_id, {_id(_source_seed('repository-documents', 'source', chr(39) + 'doc://' + chr(39) + ' || doc_id', 'text'))} AS id, "
    "'sha256:' || sha256(text) AS hash FROM documents",
    "normalize_tags": f"""
        SELECT conv_id, turn, coalesce(string_agg(tag, '|' ORDER BY pos), '') AS tags FROM (
          SELECT conv_id, turn, tag, min(pos) AS pos FROM (
            SELECT conv_id, turn, trim(unnest([role, ' ' || chr(9) || role || ' ', '', text, ' ']), {WS}) AS tag,
              unnest([1, 2, 3, 4, 5]) AS pos FROM conversations) WHERE tag <> '' GROUP BY ALL) GROUP BY ALL""",
    "slugs": rf"""
        WITH s AS (SELECT doc_id, source, lang,
          regexp_replace(regexp_replace(lower(trim(text, {WS})), '{WS_CLASS}+', '-', 'g'), '[^\p{{L}}\p{{N}}._~-]+', '-', 'g') AS slug FROM documents)
        SELECT doc_id, sha256(regexp_replace(regexp_replace(slug, '-+', '-', 'g'), '^-|-$', '', 'g')) AS slug_hash,
          source || '/ärger-über_' || lang || '.x~/' || doc_id AS path FROM s""",
    "document_urls": f"""
        SELECT doc_id, 'https://github.com/octo/' || source || '/blob/rel/1%2B0/' || {_encode("path || '~!*(' || chr(39) || 'é)%'")} AS blob_url,
          'https://site.example/posts/' || lower(replace(regexp_replace(
             substr(path, 9), '\\.(md|mdoc)$', '', 'i'), ' ', '-')) AS article_url,
          'github://octo/' || source || '/' || path || '?ref=rel%2F1%2B0' AS uri
        FROM (SELECT d.doc_id, source, {fx.PATH} AS path FROM documents d LEFT JOIN labels USING (doc_id))""",
    "parse_repo_url": """
        SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN source END AS owner,
          CASE lang WHEN 'en' THEN 'repo' || doc_id WHEN 'fr' THEN 'r' END AS repo,
          CASE lang WHEN 'fr' THEN 'v' || doc_id END AS branch, CASE lang WHEN 'fr' THEN 'docs/fr' END AS content_dir,
          CASE lang WHEN 'de' THEN 'repository_url must point to a repository or tree URL'
            WHEN 'es' THEN 'repository-documents repository_url must point to github.com' END AS error
        FROM documents""",
    "resolve_ref": """
        SELECT doc_id::VARCHAR AS instance_id, ref, CASE WHEN source <> 'src0' THEN dir END AS content_dir,
          CASE WHEN lang = 'de' THEN 'repository_url must point to a repository or tree URL'
            WHEN lang NOT IN ('en', 'fr') THEN 'repository-documents repository_url must point to github.com'
            WHEN ref IS NULL THEN 'repository does not expose a default branch; set config.branch'
            WHEN source = 'src0' THEN 'repository-documents content_dir must be a repository-relative directory' END AS error
        FROM (SELECT *, CASE WHEN n_chars < 500 THEN 'dev' WHEN lang = 'fr' THEN 'v' || doc_id
            WHEN source <> 'src3' THEN 'trunk' END AS ref,
            CASE WHEN source = 'src1' THEN 'posts' WHEN lang = 'fr' THEN 'docs/fr' ELSE 'src/content/blogs' END AS dir FROM documents)""",
    "privacy_defaults": """
        SELECT doc_id, CASE WHEN toxic = 1 THEN 'sensitive' ELSE 'private' END AS level,
          coalesce(toxic = 0, false) AS allow_cloud_llm FROM documents LEFT JOIN labels USING (doc_id)""",
    "manual_captures": f"""
        SELECT conv_id, turn, {_id("'{\"uri\":' || " + _json('uri') + " || ',\"note\":null,\"text\":' || coalesce(" + _json('body')
        + ", 'null') || ',\"title\":' || " + _json('role') + " || ',\"tags\":[' || " + _json('role') + " || '],\"kind\":\"' || kind || '\"}'")} AS id,
          kind, uri, role AS title, CASE WHEN body IS NULL THEN uri END AS url,
          CASE WHEN body IS NULL THEN 'reference' ELSE 'text' END AS payload_kind, body AS text,
          'sha256:' || sha256(coalesce(body, uri)) AS content_hash, CAST(NULL AS VARCHAR) AS note, role AS tags, 'private' AS level
        FROM (SELECT conv_id, turn, role, CASE WHEN turn > 0 THEN nullif(trim(text, {WS}), '') END AS body,
            CASE WHEN turn = 0 OR trim(text, {WS}) = '' THEN 'url' ELSE 'text' END AS kind,
            CASE WHEN turn = 0 THEN 'HTTPS://chat.example/' || conv_id ELSE 'text://manual/' || sha256(text) END AS uri FROM conversations)""",
    "manual_uri": """
        SELECT conv_id, turn, CASE WHEN role = 'user' AND turn > 0 THEN 'https://chat.example/x'
            WHEN role <> 'user' AND text <> '' THEN 'text://manual/' || sha256(text) END AS uri,
          CASE WHEN role = 'user' AND turn = 0 AND text <> '' OR role <> 'user' AND text = ''
            THEN 'capture requires exactly one of url or text' END AS problem FROM conversations""",
    "import_files": f"""SELECT DISTINCT NULL AS problem, id || '.json' AS file_name, id, uri, text,
          regexp_replace(metadata, '^.*:200,"content_length":([0-9]+)[}}]$', '{{"content_length":\\1,"status":200}}') AS metadata FROM ({WEB})""",
    "legacy_import": f"""
        WITH ids AS (SELECT DISTINCT id, ('0x' || right(id, 1))::INT AS kind FROM ({WEB}))
        SELECT id, CASE WHEN kind = 15 THEN 'Unsupported capture schema' WHEN kind % 4 = 1 THEN 'sent' WHEN kind % 4 = 2 THEN 'failed' ELSE 'pending' END AS status,
          CASE WHEN kind <> 15 THEN kind % 5 + (kind % 4 = 2)::INT END AS attempts,
          CASE WHEN kind <> 15 AND kind % 2 = 0 THEN 'why ' || id END AS last_error, CASE WHEN kind <> 15 THEN 't' || kind END AS updated_at FROM ids""",
    "import_captures": f"""
        SELECT event_id, {CAPTURE_PROBLEM.format(click='NULL')} AS problem,
          CASE event_type WHEN 'signup' THEN 'c' || user_id WHEN 'click' THEN 'e' || user_id END AS id,
          CASE WHEN event_type IN ('signup', 'click') THEN 'u' || user_id END AS uri,
          CASE event_type WHEN 'signup' THEN 'public' WHEN 'click' THEN 'sensitive' END AS level,
          CASE event_type WHEN 'signup' THEN 'a' WHEN 'click' THEN '' END AS tags FROM events""",
    "capture_rejects": f"""
        SELECT event_id, problem FROM (SELECT event_id, {CAPTURE_PROBLEM.format(click="'Unsupported capture schema'")} AS problem FROM events)
        WHERE problem IS NOT NULL""",
    "legacy_outbox": """
        SELECT 'e' || event_id AS id, CASE event_type WHEN 'purchase' THEN 'sent' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
          event_type <> 'view' AS readable FROM events""",
    "listing_guard": """
        SELECT DISTINCT source AS instance_id, 'repository tree is truncated; narrow config.content_dir before collecting' AS error
        FROM documents WHERE source < 'src3'""",
    "listing_filter": REPO + "SELECT instance_id, path, sha FROM listed",
    "blob_decode": """
        SELECT doc_id::VARCHAR AS sha, CASE WHEN lang <> 'es' THEN text END AS text,
          CASE WHEN lang = 'es' THEN 'blob response is not base64: ' || doc_id END AS problem FROM documents""",
    "checkpoint_valid": REPO + "SELECT instance_id, path, sha FROM before",
    "unchanged_sources": REPO + "SELECT instance_id FROM same",
    "changed_files": REPO + "SELECT instance_id, path, sha FROM changed",
    "stream_changes_split": REPO + "SELECT instance_id, path, sha FROM changed",
    "stream_rejects": f"""
        SELECT url, CASE WHEN url = 'mailto:a@b' THEN 'requires an http(s) config.url'
            WHEN contains(url, '://1.2.3.256') THEN '{BAD_HOST}' END AS problem, count(*) AS pages
        FROM (SELECT CASE WHEN length(html) % 5 = 0 THEN 'mailto:a@b'
            WHEN length(html) % 3 = 0 THEN replace(url, regexp_extract(url, '^https?://([^/]+)', 1), '1.2.3.256') ELSE url END AS url FROM pages)
        GROUP BY ALL""",
    "stream_changes": REPO + "SELECT instance_id, path, sha FROM changed",
    "checkpoint_next": REPO
    + _CHECKPOINT.format(
        columns="'https://github.com/octo/' || s.instance_id AS repository, 'main' AS ref, 'content' AS content_dir, "
        f"true AS files_tracked, '{NOW}' AS scanned_at",
        fresh="changed",
    ),
    "full_rescan": REPO + _CHECKPOINT.replace("{columns}, ", "").format(fresh="listed"),
    "repo_captures": REPO
    + f"""
        SELECT {_id("'{\"connector\":\"repository-documents\",\"instance\":' || " + _json('instance_id') + " || ',\"uri\":' || " + _json('uri')
        + " || ',\"contentHash\":\"sha256:' || sha || '\"}'")} AS id, instance_id, uri,
          CASE lang WHEN 'en' THEN 'Notes of ' || source WHEN 'fr' THEN 'it''s ' || doc_id ELSE slug END AS title,
          'https://site.example/posts/' || slug AS url, trim(text, {WS}) AS text, raw_ref, 'sha256:' || sha AS content_hash,
          {FRONT_TAGS} AS tags,
          '{{"collection":"blogs","path":"' || path || '","source_name":"documents","repository":"https://github.com/octo/' || source
            || '","ref":"main","blob_sha":"' || sha || '","source_url":"' || raw_ref || '","frontmatter":' || {FRONT_JSON} || '}}' AS metadata,
          'private' AS level, sha AS cursor
        FROM (SELECT *, 'github://octo/' || source || '/' || path || '?ref=main' AS uri, lang || '-notes/' || doc_id || '_' || lang AS slug,
            'https://github.com/octo/' || source || '/blob/main/' || replace(path, ' ', '%20') AS raw_ref FROM changed)""",
    "fetch_triage": """
        WITH r AS (SELECT event_id, event_type AS t, value, props, 'https://api.example.com/items/' || event_id AS url FROM events),
        c AS (SELECT *, CASE t WHEN 'signup' THEN 'ok' WHEN 'purchase' THEN CASE WHEN value < 10 THEN 'timeout' ELSE 'network' END
            WHEN 'error' THEN CASE WHEN value < 20 THEN 'rate_limit' ELSE 'http_error' END
            WHEN 'click' THEN CASE WHEN value < 10 THEN 'denied' ELSE 'not_found' END
            ELSE CASE WHEN value < 10 THEN 'http_error' ELSE 'invalid_json' END END AS category FROM r)
        SELECT event_id, category, CASE category
          WHEN 'timeout' THEN 'Request to GitHub timed out after 20000ms: ' || url
          WHEN 'network' THEN 'Could not reach GitHub (fetch failed): ' || url || '. Check network connectivity or proxy settings.'
          WHEN 'rate_limit' THEN 'GitHub API rate limit exhausted (resets at ' || CASE WHEN value >= 5 AND value < 8 THEN '2030-03-17T17:46:40.000Z' ELSE 'an unknown time' END
            || '). ' || CASE WHEN value >= 9 THEN 'Wait for the window to reset or narrow config.content_dir.'
              ELSE 'Set config.token_env to raise the limit from 60 to 5000 requests per hour.' END
          WHEN 'denied' THEN 'GitHub denied the request: HTTP 401 ' || url || '. ' || CASE WHEN value >= 9
            THEN 'The token in config.token_env may be expired or lack repository access.' ELSE 'This repository looks private; set config.token_env.' END
          WHEN 'not_found' THEN 'GitHub resource not found: ' || url || '. Check repository_url, branch and content_dir.'
          WHEN 'http_error' THEN 'GitHub request failed: HTTP ' || CASE t WHEN 'error' THEN 429 ELSE 503 END || ' ' || url || ' — '
            || CASE t WHEN 'error' THEN props ELSE 'oops ' || props END
          WHEN 'invalid_json' THEN 'GitHub request returned invalid JSON: ' || url END AS message FROM c""",
    "frontmatter_split": FRONT + f" SELECT doc_id, block, trim(text, {WS}) AS body FROM docs",
    "frontmatter_lines": FRONT
    + f""", l AS (SELECT doc_id, unnest(string_split(block, chr(10))) AS raw, unnest(range(1, len(string_split(block, chr(10))) + 1)) AS line FROM docs)
        SELECT doc_id, line, length(regexp_extract(raw, '^[ \\t]*')) AS indent, trim({_CONTENT}, {WS}) AS content,
          starts_with(raw, chr(9)) AS tab FROM l""",
    "frontmatter_leaves": _leaves()
    + " UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL FROM documents WHERE false",
    "frontmatter_nested": f"SELECT doc_id, {FRONT_JSON} AS frontmatter FROM documents",
    "frontmatter_tags": f"SELECT doc_id, {FRONT_TAGS} AS tags FROM documents",
    "frontmatter_rejects": """
        SELECT doc_id, CASE WHEN source IN ('src0', 'src3', 'src7') OR substr(source, 4)::INT > 8 THEN 2 ELSE 1 END::BIGINT AS line,
          CASE source WHEN 'src0' THEN 'tab indentation is not supported, use spaces'
            WHEN 'src1' THEN 'YAML anchors and aliases are not supported' WHEN 'src2' THEN 'YAML merge keys are not supported'
            WHEN 'src3' THEN 'expected "key: value", found "just text"' WHEN 'src4' THEN 'the document must be a mapping, not a sequence'
            WHEN 'src5' THEN 'unterminated inline sequence' WHEN 'src6' THEN 'inline mapping entry "a" is missing a value'
            WHEN 'src7' THEN 'unexpected indentation' WHEN 'src8' THEN 'complex mapping keys are not supported'
            ELSE 'multiple YAML documents are not supported' END AS reason FROM documents WHERE lang NOT IN ('en', 'fr', 'de')""",
    "enqueue": DOC_CAPTURES
    + "SELECT id, doc_id, level, length(body) AS n_chars FROM firsts WHERE id NOT IN (SELECT id FROM captures WHERE quality = 1)",
    "run_report": DOC_CAPTURES
    + "SELECT (SELECT count(*) FROM captures) AS collected, count(*) AS enqueued FROM firsts WHERE id NOT IN (SELECT id FROM captures WHERE quality = 1)",
    "privacy_conflicts": DOC_CAPTURES
    + """, ranked AS (SELECT id, max(list_position(['public', 'private', 'sensitive'], level)) AS asked FROM captures GROUP BY id)
        SELECT id, level AS stored_level, ['public', 'private', 'sensitive'][asked] AS requested_level FROM firsts JOIN ranked USING (id)
        WHERE asked > list_position(['public', 'private', 'sensitive'], level)""",
    "privacy_gate": DOC_CAPTURES
    + f"""SELECT 'files' AS target, id, true AS accepted, CAST(NULL AS VARCHAR) AS reason FROM firsts UNION ALL
        SELECT 'hook', id, level <> 'sensitive', CASE WHEN level = 'sensitive' THEN {REASON} END FROM firsts""",
    "sync_limit": DOC_CAPTURES
    + f""", seen AS (SELECT *, sum((level <> 'sensitive')::INT) OVER (ORDER BY id || '.json' ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tried FROM firsts)
        SELECT id, level, CASE WHEN level = 'sensitive' THEN {REASON} END AS reason FROM seen WHERE coalesce(tried, 0) < 40""",
    "sync_ids": DOC_CAPTURES
    + f"SELECT id, level, CASE WHEN level = 'sensitive' THEN {REASON} END AS reason FROM firsts WHERE id IN (SELECT id FROM captures WHERE quality = 1)",
    "push_outcomes": ATTEMPTS + "SELECT * FROM outcomes",
    "sync_summary": ATTEMPTS
    + """SELECT 'hook' AS target, count(*) AS attempted, count(*) FILTER (WHERE status = 'sent') AS delivered,
        count(*) FILTER (WHERE status = 'failed') AS failed, (SELECT count(*) FROM firsts WHERE level = 'sensitive') AS skipped FROM outcomes""",
    "sync_loop": ATTEMPTS
    + """SELECT status, attempts, count(*) AS entries FROM (
          SELECT status, CASE WHEN status = 'failed' THEN 2 ELSE 0 END AS attempts FROM outcomes
          UNION ALL SELECT 'pending', 0 FROM firsts WHERE level = 'sensitive') GROUP BY ALL""",
    "sync_custom": DOC_CAPTURES
    + """SELECT level, CASE WHEN level = 'sensitive' THEN 'skipped' WHEN right(id, 1) = '0' THEN 'failed' ELSE 'delivered' END AS outcome,
          CASE WHEN level = 'sensitive' THEN 'not on a shelf' WHEN right(id, 1) = '0' THEN 'full' END AS detail, count(*) AS entries
        FROM firsts GROUP BY ALL""",
    "run_registry": f"""
        WITH asked AS (SELECT *, 'page' || page_id AS id, CASE WHEN page_id % 13 = 0 THEN 'nothing' ELSE 'web-page' END AS connector,
          CASE WHEN page_id % 13 = 0 THEN 'Unknown connector: nothing'
            WHEN page_id % 7 = 0 THEN 'Connector instance is disabled: page' || page_id
            WHEN page_id % 11 = 0 THEN 'Invalid config for connector web-page (instance page' || page_id || '):' || chr(10)
              || '  - config.tagz is not a recognized option (did you mean "tags"?)' || chr(10) || '  - url must be string, received number'
            WHEN page_id % 5 = 0 THEN 'Invalid config for connector web-page (instance page' || page_id || '):' || chr(10) || '  - config.url is required'
            END AS error FROM pages),
        found AS (SELECT a.id, {PAGE_URI.replace("url", "p.url")} AS uri, p.html FROM asked a JOIN pages p ON p.url = a.url WHERE a.error IS NULL)
        SELECT id, connector, error, CAST(NULL AS BIGINT) AS collected, CAST(NULL AS BIGINT) AS enqueued FROM asked WHERE error IS NOT NULL
        UNION ALL SELECT NULL, 'web-page', NULL, count(*), count(DISTINCT (id, uri, html)) FROM found HAVING count(*) > 0""",
    "outbox_state": LOG + "SELECT * FROM entries",
    "outbox_compacted": LOG + "SELECT * FROM entries",
    "outbox_list": LOG + "SELECT id, status, attempts FROM entries WHERE status = 'pending'",
    "outbox_summary": LOG
    + """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'sent') AS sent,
        count(*) FILTER (WHERE status = 'failed') AS failed FROM entries""",
    "outbox_counts": LOG
    + """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'sent') AS sent,
        count(*) FILTER (WHERE status = 'failed') AS failed FROM entries""",
    "outbox_rejects": LOG
    + """SELECT seq, id, event, 'Unknown outbox entry: ' || id AS error FROM placed
        WHERE event IN ('sent', 'failed', 'pending') AND (born IS NULL OR seq < born)""",
    "retry": LOG + f"SELECT 1000000000 AS seq, id, 'pending' AS event, '{NOW}' AS \"at\" FROM entries WHERE status = 'failed'",
    "config_upsert": _OLD_NEW
    + """SELECT id, coalesce(n.connector, o.connector) AS connector, coalesce(n.props, o.props) AS props,
          (o.id IS NULL)::BIGINT AS is_new, coalesce(o.position, n.first_at) AS position
        FROM (SELECT id, max(connector) AS connector, max(props) AS props, min(position) AS position FROM old GROUP BY id) o
        FULL JOIN (SELECT id, arg_max(connector, position) AS connector, arg_max(props, position) AS props, min(position) AS first_at FROM new GROUP BY id) n USING (id)""",
    "config_remove": _OLD_NEW
    + "SELECT DISTINCT id, id IN (SELECT id FROM old) AS removed FROM new",
    "config_carry": _OLD_NEW
    + f""", kept AS (SELECT id, max(CASE WHEN props < '{{"k": 2' THEN '0 1 * * *' END) AS schedule, max(props) AS checkpoint FROM old GROUP BY id),
        asked AS (SELECT id, CASE WHEN count(*) > 13 THEN 'web-page' ELSE 'repository-documents' END AS connector,
          CASE WHEN count(*) > 15 THEN '@daily' END AS schedule, max(props) AS config FROM new GROUP BY id)
        SELECT a.id, a.connector, coalesce(a.schedule, k.schedule, m.default_schedule) AS schedule, a.config, k.checkpoint
        FROM asked a LEFT JOIN kept k USING (id) LEFT JOIN ({_LOOKUP}) m(connector, default_schedule) ON m.connector = a.connector""",
    "runnable_instances": """
        SELECT event_id::VARCHAR AS id, connector, trigger, CASE WHEN trigger = 'cron' THEN 'Invalid trigger: cron'
          WHEN connector = 'other' THEN 'Unknown connector: other'
          WHEN event_type = 'view' AND trigger = 'schedule' THEN 'Connector instance is disabled: ' || event_id END AS error
        FROM (SELECT *, CASE WHEN event_type = 'click' THEN 'other' ELSE 'web-page' END AS connector,
          CASE WHEN event_type = 'error' THEN 'cron' WHEN value < 10 THEN 'manual' ELSE 'schedule' END AS trigger FROM events)""",
    "config_errors": f"WITH c AS (SELECT event_id, {fx.OPTIONS_JSON}::JSON AS config FROM events) " + _option_checks(),
    "rule_sets": """
        WITH c AS (SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 'public' ELSE role END AS level FROM conversations),
        known AS (SELECT unnest(['public', 'private', 'sensitive']) AS level),
        e AS (
          SELECT 'page' AS rule_set, conv_id, turn, unnest([
            CASE WHEN turn % 2 = 1 THEN 'url must be a valid absolute URI' END,
            'tags[1] must be string, received number', 'tags[2] must be string, received null',
            CASE WHEN level NOT IN (SELECT level FROM known) THEN 'privacy_level must be one of "public", "private", "sensitive"' END,
            'config.titel is not a recognized option (did you mean "title"?)']) AS error FROM c
          UNION ALL SELECT 'file', conv_id, turn, unnest([
            CASE WHEN turn = 0 THEN 'directory must be at least 1 character(s)' END,
            CASE WHEN role NOT IN (SELECT level FROM known) THEN 'include_privacy_levels[1] must be one of "public", "private", "sensitive"' END]) FROM c
          UNION ALL SELECT 'webhook', conv_id, turn, unnest([
            CASE WHEN turn % 3 = 0 THEN 'config.url is required' END,
            CASE WHEN turn % 2 = 1 THEN 'timeout_ms must be integer, received number' END,
            CASE WHEN role <> 'user' THEN 'headers must be object, received array' END]) FROM c
          UNION ALL SELECT 'list', conv_id, turn, unnest([
            CASE WHEN turn < 2 THEN 'parts must contain at least 2 item(s)' END,
            CASE WHEN (turn = 1 AND length(role) < 5) OR turn > 1 THEN 'parts[0].name must be at least 5 character(s)' END,
            CASE WHEN turn > 1 THEN 'config.parts[1].name is required' END,
            CASE WHEN turn > 1 THEN 'config.parts[1].size is not a recognized option' END]) FROM c)
        SELECT * FROM e WHERE error IS NOT NULL""",
    "option_suggestions": f"""
        SELECT event_id, option, {_hint('option')} AS hint FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'site_ur'
          WHEN 'view' THEN 'token_' || translate(props, '{{}}": ', '') WHEN 'error' THEN 'allow_llm'
          ELSE event_type || '_' || translate(props, '{{}}": ', '') || 'ranch' END AS option FROM events)""",
    "instances_normalized": """
        SELECT event_id, CASE event_type WHEN 'error' THEN 'connector instance requires a non-empty id'
            WHEN 'click' THEN 'connector instance "i' || user_id || '" has a non-boolean enabled'
            WHEN 'purchase' THEN 'connector instance "i' || user_id || '" has a non-object config' END AS problem,
          CASE WHEN event_type IN ('signup', 'view') THEN 'i' || user_id END AS id,
          CASE event_type WHEN 'signup' THEN 'web-page' WHEN 'view' THEN 'y' END AS connector,
          CASE event_type WHEN 'signup' THEN true WHEN 'view' THEN false END AS enabled,
          CASE event_type WHEN 'view' THEN '0 3 * * *' END AS schedule,
          CASE event_type WHEN 'signup' THEN '{}' WHEN 'view' THEN CAST(json(props) AS VARCHAR) END AS config,
          CAST(NULL AS VARCHAR) AS checkpoint FROM events""",
    "targets_normalized": """
        SELECT event_id, CASE event_type WHEN 'error' THEN 'delivery target "t' || user_id || '" has an unknown kind; supported kinds are file, webhook'
            WHEN 'view' THEN 'webhook target requires an http(s) config.url' END AS problem,
          CASE WHEN event_type IN ('signup', 'click', 'purchase') THEN 't' || user_id END AS id,
          CASE event_type WHEN 'signup' THEN 'file' WHEN 'click' THEN 'webhook' WHEN 'purchase' THEN 'webhook' END AS kind,
          CASE event_type WHEN 'signup' THEN 'out/' || user_id END AS directory,
          CASE event_type WHEN 'click' THEN 'https://h.example/' || user_id WHEN 'purchase' THEN 'http://h.example' END AS url,
          CASE event_type WHEN 'click' THEN user_id::DOUBLE WHEN 'purchase' THEN 20000.0::DOUBLE END AS timeout_ms,
          CASE event_type WHEN 'signup' THEN 'public|private|sensitive' WHEN 'click' THEN 'sensitive' WHEN 'purchase' THEN 'public|private' END AS levels
        FROM events""",
    "incremental_runs": REPO
    + "SELECT 1 AS step, count(*) AS collected, count(*) AS enqueued FROM listed UNION ALL SELECT 2, 0, 0",
}

_STREAM = f"""
WITH captures AS (
  SELECT DISTINCT {_id("'{\"uri\":' || " + _json(_TEXT_ADDRESS) + " || ',\"note\":null,\"text\":' || " + _json(f"trim(text, {WS})")
                       + " || ',\"title\":null,\"tags\":[' || " + _json('lang') + " || '],\"kind\":\"text\"}'")} AS id, lang FROM documents)
"""
ORACLES["stream_enqueue"] = _STREAM + "SELECT id, 'pending' AS status, 0 AS attempts FROM captures"
ORACLES["stream_sync"] = (
    _STREAM
    + """SELECT id, CASE WHEN lang = 'de' THEN 'pending' WHEN right(id, 1) = '0' THEN 'failed' ELSE 'sent' END AS status,
      (lang <> 'de' AND right(id, 1) = '0')::BIGINT AS attempts,
      CASE WHEN lang <> 'de' AND right(id, 1) = '0' THEN 'Webhook responded HTTP 500' END AS last_error FROM captures"""
)
