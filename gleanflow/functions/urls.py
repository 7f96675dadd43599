"""URL columns: canonical form, percent encoding, repository URLs and derived links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanflow.functions.hosts import ascii_host
from gleanflow.functions.text import blank_to_null, trim_blanks

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):/*(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"

# Escapes that component encoding leaves as plain characters.
PLAIN_ESCAPES = (
    ("%21", "!"),
    ("%27", "'"),
    ("%28", "("),
    ("%29", ")"),
    ("%7E", "~"),
)
# Ports dropped from canonical URLs.
DEFAULT_PORTS = {"http": "80", "https": "443"}
REPOSITORY_HOSTS = ("github.com", "www.github.com")
REPOSITORY_SITE = "https://github.com"


def is_web_url(url: Column) -> Column:
    return F.rlike(url, F.lit("(?i)^https?://"))


def encode_component(text: Column) -> Column:
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for escape, char in PLAIN_ESCAPES:
        encoded = F.replace(encoded, F.lit(escape), F.lit(char))
    return encoded


def encode_path(path: Column) -> Column:
    return F.replace(encode_component(path), F.lit("%2F"), F.lit("/"))


def _encode_unsafe(text: Column, unsafe: str) -> Column:
    """Percent-encode only the characters matched by ``unsafe``."""
    chars = F.transform(
        F.split(text, ""),
        lambda c: F.when(
            F.rlike(c, F.lit(unsafe)), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
        ).otherwise(c),
    )
    return F.when(F.rlike(text, F.lit(unsafe)), F.array_join(chars, "")).otherwise(text)


_DOT = r"(?i)^(\.|%2e)$"
_DOTS = r"(?i)^(\.|%2e){2}$"


def _resolve_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)

    def step(kept: Column, segment: Column) -> Column:
        up = F.rlike(segment, F.lit(_DOTS))
        skip = F.rlike(segment, F.lit(_DOT))
        shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(up, shorter).when(skip, kept).otherwise(F.concat(kept, F.array(segment)))

    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.greatest(F.size(segments), F.lit(1))),
        F.array(F.lit("")),
        step,
    )
    dotted_end = F.rlike(last, F.lit(_DOT)) | F.rlike(last, F.lit(_DOTS))
    resolved = F.array_join(F.when(dotted_end, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(F.rlike(path, F.lit(r"(?i)/(\.|%2e){1,2}(/|$)")), resolved).otherwise(path)


_ENDS_IN_NUMBER = r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$"


def _number(part: Column) -> Column:
    """Value of one part of a numeric host (decimal, ``0`` octal, ``0x`` hexadecimal), null for other text."""

    def value(digits: Column, base: int) -> Column:
        # More than 11 digits are beyond any address in each of the bases.
        bounded = F.when(F.length(digits) <= 11, digits).otherwise("7" * 11)
        return F.when(digits == "", F.lit(0)).otherwise(F.conv(bounded, base, 10).cast("bigint"))

    bare = F.regexp_replace(part, "^0x0*|^0+", "")
    return (
        F.when(F.rlike(part, F.lit("^0x[0-9a-f]*$")), value(bare, 16))
        .when(F.rlike(part, F.lit("^0[0-7]*$")), value(bare, 8))
        .when(F.rlike(part, F.lit("^[1-9][0-9]*$")), value(part, 10))
    )


def _ipv4(host: Column) -> Column:
    """Dotted form of a host that ends in a number, null where it is no address.

    Up to four parts; the last one fills all the bytes that the others leave.
    """
    values = F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), _number)

    def dotted(parts: Column) -> Column:
        count = F.size(parts)
        head, last = F.slice(parts, F.lit(1), count - 1), F.element_at(parts, -1)
        byte_count = 5 - count
        fits = (
            (count <= 4)
            & F.forall(parts, lambda v: v.isNotNull())
            & F.forall(head, lambda v: v < 256)
            & (last < F.pow(F.lit(256), byte_count))
        )
        tail = F.transform(
            F.sequence(F.lit(1), F.greatest(byte_count, F.lit(1))),
            lambda i: F.pmod(F.floor(last / F.pow(F.lit(256), byte_count - i)).cast("bigint"), F.lit(256)),
        )
        return F.when(fits, F.array_join(F.concat(head, tail).cast("array<string>"), "."))

    return _let(values, dotted)


_GROUPS = r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"
_BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# The longest run of zeros first; of equal ones the first.
_ZERO_RUNS = [rf"^(?:|(.*?):)0(?::0){{{run - 1}}}(?::(.*))?$" for run in range(8, 1, -1)]
_V4_TAIL = rf"^(.*:){_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"


def _ipv6(host: Column) -> Column:
    """Shortest form of a bracketed address (first longest run of zeros left out), null where it is no address."""
    inner = F.regexp_extract(host, r"^\[(.*)\]$", 1)
    byte = lambda index: F.regexp_extract(inner, _V4_TAIL, index).try_cast("int")
    pair = lambda index: F.lower(F.hex(byte(index) * 256 + byte(index + 1)))
    # A dotted tail stands for the last two groups.
    hexed = F.when(
        F.rlike(inner, F.lit(_V4_TAIL)), F.concat(F.regexp_extract(inner, _V4_TAIL, 1), pair(2), F.lit(":"), pair(4))
    ).otherwise(inner)

    def groups(side: Column) -> Column:
        return F.filter(F.split(side, ":"), lambda group: group != "")

    def shortest(sides: Column) -> Column:
        left = F.get(sides, F.lit(0))
        right = F.coalesce(F.get(sides, F.lit(1)), F.lit(""))
        given = F.size(groups(left)) + F.size(groups(right))
        fits = (
            F.forall(sides, lambda side: F.rlike(side, F.lit(_GROUPS)))
            & (((F.size(sides) == 1) & (given == 8)) | ((F.size(sides) == 2) & (given <= 7)))
        )
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0)))
        full = F.transform(
            F.concat(groups(left), zeros, groups(right)), lambda group: F.regexp_replace(group, "^0+(?=.)", "")
        )
        return F.when(fits, _let(F.array_join(full, ":"), bracketed))

    def bracketed(plain: Column) -> Column:
        longest = F.get(F.filter(F.array(*[F.lit(run) for run in _ZERO_RUNS]), lambda run: F.rlike(plain, run)), F.lit(0))
        short = F.coalesce(F.regexp_replace(plain, longest, F.lit("$1::$2")), plain)
        return F.concat(F.lit("["), short, F.lit("]"))

    return _let(F.split(hexed, "::"), shortest)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def canonical_url(url: Column) -> Column:
    """Struct ``(uri, issue)``: the serialized URL without fragment, or why there is none.

    Numeric hosts are addresses in any of their spellings and come out in the usual one. International names get their ASCII
    form; those that would need mapping tables for it are reported and not guessed.
    """
    cleaned = F.regexp_replace(
        F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", ""
    )
    scheme = F.lower(F.regexp_extract(cleaned, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    head = F.regexp_extract(cleaned, r"^([^?#]*)", 1)
    slashed = F.concat(
        F.replace(head, F.lit("\\"), F.lit("/")), F.substring(cleaned, F.length(head) + 1, F.length(cleaned))
    )
    part = lambda index: F.regexp_extract(slashed, _PARTS, index)
    named = F.lower(part(3))
    decoded = F.lower(F.try_url_decode(F.replace(named, F.lit("+"), F.lit("%2B"))))
    pieces = F.struct(
        url.isNull().alias("missing"),
        scheme.alias("scheme"),
        part(1).alias("read"),
        part(2).alias("userinfo"),
        _let(F.when(F.contains(named, F.lit("%")), F.coalesce(decoded, named)).otherwise(named), _known_form).alias("named"),
        part(4).alias("port"),
        part(5).alias("path"),
        part(6).alias("query"),
    )
    # Inside the lambdas the pieces and the host are values, read once however often they are named.
    return _let(pieces, lambda p: _let(_host(p["named"]), lambda host: _serialized(p, host)))


def _known_form(named: Column) -> Column:
    """ASCII form of a name where it has one; other names stay and are refused later."""
    return F.coalesce(ascii_host(named), named)


def _host(named: Column) -> Column:
    return (
        F.when(F.startswith(named, F.lit("[")), _ipv6(named))
        .when(F.rlike(named, F.lit(_ENDS_IN_NUMBER)), _ipv4(named))
        .otherwise(named)
    )


def _serialized(pieces: Column, host: Column) -> Column:
    """Struct ``(uri, issue)`` of the pieces of a URL and its address or name (null: no valid one)."""
    scheme, read, userinfo, named, port, path, query = (
        pieces[name] for name in ("scheme", "read", "userinfo", "named", "port", "path", "query")
    )
    known = scheme.isin(*DEFAULT_PORTS)
    bare_port = F.regexp_replace(port, "^0+(?=[0-9])", "")
    default_port = F.create_map(*[F.lit(x) for pair in DEFAULT_PORTS.items() for x in pair])[scheme]
    authority = F.concat(
        F.when(userinfo != "", F.concat(userinfo, F.lit("@"))).otherwise(""),
        host,
        F.when((bare_port == "") | (bare_port == default_port), "").otherwise(
            F.concat(F.lit(":"), bare_port)
        ),
    )
    full_path = F.when(path == "", "/").otherwise(_resolve_dots(path))
    uri = F.concat(
        scheme,
        F.lit("://"),
        authority,
        _encode_unsafe(full_path, r'[^\x21-\x7E]|["<>^`{}]'),
        _encode_unsafe(F.when(query == "?", "").otherwise(query), r"[^\x21-\x7E]|[\"<>']"),
    )
    issue = (
        F.when(pieces["missing"] | (scheme == ""), "not an absolute URL")
        .when(~known, "unsupported scheme")
        .when(read == "", "unreadable authority")
        .when(named == "", "empty host")
        .when(F.rlike(named, F.lit(r"[^\x00-\x7F]")), "internationalized host")
        .when(host.isNull(), "invalid host")
        .when(~F.startswith(named, F.lit("[")) & F.rlike(named, F.lit(r"[\x00-\x20\x7F#%/:<>?@\[\]\\^|]")), "invalid host")
        .when((path != "") & ~F.startswith(path, F.lit("/")), "invalid port")
        .when(F.length(bare_port) > 5, "invalid port")
        .when(bare_port.try_cast("int") > 65535, "invalid port")
    )
    return F.struct(F.when(issue.isNull(), uri).alias("uri"), issue.alias("issue"))


def is_absolute_uri(text: Column) -> Column:
    """True where an absolute URI parser accepts the text (scheme, and a host for web schemes)."""
    scheme = F.lower(F.regexp_extract(trim_blanks(text), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    hosted = F.rlike(text, F.lit(r"(?i)^\s*(https?|wss?|ftp):[/\\]*[^/\\?#:\s@]+([/\\?#:@]|$)"))
    return (scheme != "") & (~scheme.isin("http", "https", "ws", "wss", "ftp") | hosted)


# --- repository URLs --------------------------------------------------------------


def parse_repository_url(url: Column, label: str = "repository source") -> Column:
    """Struct ``(owner, repo, branch, content_dir, error)`` of a repository or tree URL."""
    text = trim_blanks(url)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*:/*[^/?#]*([^?#]*)", 1)
    # A plus sign is literal in a path, so it is shielded from form decoding.
    parts = F.transform(
        F.filter(F.split(path, "/"), lambda part: part != ""),
        lambda part: F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))),
    )
    at = lambda index: F.get(parts, F.lit(index))
    repo = F.regexp_replace(at(1), r"(?i)\.git$", "")
    branch = F.when((at(2) == "tree") & (at(3) != ""), at(3))
    inner = F.array_join(F.slice(parts, F.lit(5), F.greatest(F.size(parts), F.lit(1))), "/")
    error = (
        F.when(~F.coalesce(is_absolute_uri(text), F.lit(False)), f"{label} repository_url must be a valid URL")
        .when(
            (scheme != "https") | ~host.isin(*REPOSITORY_HOSTS),
            f"{label} repository_url must point to github.com",
        )
        .when(F.exists(parts, lambda part: part.isNull()), f"{label} repository_url must be a valid URL")
        .when((F.size(parts) < 2) | (repo == ""), "repository_url must include owner and repository")
        .when(
            (F.size(parts) > 2) & (at(2) != "tree"),
            "repository_url must point to a repository or tree URL",
        )
    )
    keep = lambda column: F.when(error.isNull(), column)
    return F.struct(
        keep(at(0)).alias("owner"),
        keep(repo).alias("repo"),
        keep(branch).alias("branch"),
        keep(F.when(branch.isNotNull(), F.nullif(inner, F.lit("")))).alias("content_dir"),
        error.alias("error"),
    )


def normalize_content_dir(value: Column, label: str = "repository source") -> Column:
    """Struct ``(content_dir, error)``: slashes trimmed; empty or climbing paths are errors."""
    trimmed = F.regexp_replace(trim_blanks(value), "^/+|/+$", "")
    bad = (trimmed == "") | F.array_contains(F.split(trimmed, "/"), "..")
    error = F.when(
        F.coalesce(bad, F.lit(True)), f"{label} content_dir must be a repository-relative directory"
    )
    return F.struct(F.when(error.isNull(), trimmed).alias("content_dir"), error.alias("error"))


def trim_trailing_slash(url: Column) -> Column:
    return F.regexp_replace(blank_to_null(url), "/+$", "")


def repository_url(owner: Column, repo: Column) -> Column:
    return F.concat(F.lit(f"{REPOSITORY_SITE}/"), owner, F.lit("/"), repo)


def blob_url(owner: Column, repo: Column, ref: Column, path: Column) -> Column:
    return F.concat(
        repository_url(owner, repo), F.lit("/blob/"), encode_path(ref), F.lit("/"), encode_path(path)
    )


def article_url(site_url: Column, slug: Column) -> Column:
    site = F.nullif(trim_trailing_slash(site_url), F.lit(""))
    return F.concat(site, F.lit("/posts/"), encode_path(slug))


def source_uri(owner: Column, repo: Column, path: Column, ref: Column) -> Column:
    return F.concat(
        F.lit("github://"), owner, F.lit("/"), repo, F.lit("/"), path, F.lit("?ref="), encode_component(ref)
    )


def submission_uri(url: Column, text: Column) -> Column:
    """The given URL, or an address derived from the untrimmed text."""
    return F.coalesce(
        F.nullif(url, F.lit("")), F.concat(F.lit("text://manual/"), F.sha2(text, 256))
    )
