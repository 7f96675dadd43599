"""Surrogates for personal data: detected entities are replaced by keyed, type-consistent stand-ins.

A surrogate depends on a secret key, the entity's kind and its normal form, so the same entity gets the same surrogate
in every document and spelling. It is written in the form of each mention: separators, letter case and script stay,
digits become digits and letters letters of the same script. Card numbers keep whether their check digit
holds, bank accounts get right check digits, phone numbers keep their country, addresses stay public or private, given names keep their
gender, and a full name and its surname alone stay consistent. A name that a text introduces by a title or a known given name is
replaced wherever that text has it. Dates, ranges of years, numbers in thousands and ISBNs are no phones or cards.

Two entities of a kind must not share a surrogate, and a surrogate must not be an entity of the corpus. Both are
checked over the distinct entities of the whole corpus: those in conflict draw again until none is left, the smallest
entity keeping its draw. Only documents with entities are joined with their surrogates.

Defined cases: a null text stays null and an empty one empty; documents without entities are unchanged; equal rows
are treated alike; nulls in other columns do not matter and clashing names are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanflow.llm.common import named, staged, table, unused

# A run in production passes its own secret.
KEY = b"gleanflow surrogate key"

# Given names by script and gender, and honorifics by gender.
GIVEN = {
    ("latin", "m"): "James John Robert Michael David Thomas Paul Mark Peter Hans Karl Stefan Pierre Jean Louis Carlos Juan Luis".split(),
    ("latin", "f"): "Mary Anna Emma Laura Julia Sarah Linda Susan Helen Petra Ingrid Claire Marie Sophie Carmen Lucia Elena Rosa".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική".split(),
}
MALE = "Mr Mister Herr Monsieur Señor Sr Don Господин Κύριος".split()
FEMALE = "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña Госпожа Κυρία".split()
NEUTRAL = "Dr Prof".split()
GENDER = {name.lower(): key[1] for key, names in GIVEN.items() for name in names}
NAME = r"[^\W\d_][^\W\d_]*(?:['’-][^\W\d_]+)*"

PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[^\W\d_]{2,}",
    "secret": r"(?i:\b(?:token|key|secret|password|passwd|pwd|bearer)\b\s*[=:]\s*[\"']?)(?P<v1>[A-Za-z0-9+/_\-]{12,}={0,2})",
    "hex": r"(?<![\w-])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,64}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w-])|(?<!\w)\+\d{8,15}(?!\w)|\(\d{2,5}\)[ .-]?\d{3,10}(?![\w-])",
    "name": rf"\b(?P<title>{'|'.join(MALE + FEMALE + NEUTRAL)})\b\.? (?P<v2>{NAME}(?: {NAME}){{0,2}})",
    "given": rf"\b(?P<v3>(?:{'|'.join(n for names in GIVEN.values() for n in names)}) {NAME})\b",
}
# Cheap signs that a text may hold anything of the above; each is a part of whatever its finders match.
NUMBERS = re.compile(r"\d[ .-]?\d")
SECRETS = re.compile(r"[=:]\s*[\"']?[A-Za-z0-9+/_\-]{12}|[0-9a-fA-F]{32}")
PEOPLE = frozenset((*MALE, *FEMALE, *NEUTRAL, *(n for names in GIVEN.values() for n in names)))
LETTER_RUN = re.compile(r"[^\W\d_]+")
FINDERS = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}


# --- detection -----------------------------------------------------------------------------


def may_hold(text: str) -> bool:
    """True for every text in which a finder matches."""
    return bool("@" in text or NUMBERS.search(text) or SECRETS.search(text)) or not PEOPLE.isdisjoint(LETTER_RUN.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        d = int(c) * (1 + at % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def is_phone(body: str, norm: str) -> bool:
    """A country sign, a bracket, a leading zero or a usual grouping; not dates, ranges of years or numbers in thousands."""
    if not 7 <= len(norm) <= 15:
        return False
    if "+" in body or "(" in body:
        return True
    groups = re.split(r"\D", body)
    if norm[0] == "0":
        return len(norm) >= 9 and not re.fullmatch(r"\d\d\D\d\d\D\d{4}", body)
    sizes = [len(g) for g in groups]
    return sizes in ([3, 3, 4], [3, 4, 4]) or sizes == [3, 4] and "-" in body or sizes == [3, 3, 3] and groups[1:] != ["000", "000"]


def is_isbn(digits: str) -> bool:
    return len(digits) == 13 and digits[:3] in ("978", "979") and sum(int(d) * (1, 3)[i % 2] for i, d in enumerate(digits)) % 10 == 0


def entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """``(start, end, kind, normal form, detail)`` without overlaps, kinds in the order of ``PATTERNS``."""
    found: list[tuple[int, int, str, str, str]] = []
    taken: set[int] = set()

    def take(start: int, end: int, kind: str, norm: str, detail: str = "") -> None:
        if norm and taken.isdisjoint(range(start, end)):
            taken.update(range(start, end))
            found.append((start, end, kind, norm, detail))

    for kind, finder in FINDERS.items():
        for m in finder.finditer(text):
            start, end, body = m.start(), m.end(), m[0]
            if kind == "email":
                take(start, end, kind, body.lower())
            elif kind in ("secret", "hex"):
                start, end = (m.span("v1") if kind == "secret" else (start, end))
                take(start, end, "secret", text[start:end])
            elif kind == "iban":
                norm = body.replace(" ", "")
                if 15 <= len(norm) <= 34 and mod97(norm) == 1:
                    take(start, end, kind, norm)
            elif kind in ("card", "ssn", "ip"):
                norm = body if kind == "ip" else re.sub(r"\D", "", body)
                if kind == "card" and is_isbn(norm):
                    continue
                take(start, end, kind, norm, str(luhn(norm)) if kind == "card" else "")
            elif kind == "phone":
                norm = re.sub(r"\D", "", body)
                if is_phone(body, norm):
                    country = re.match(r"\+(\d{1,3})(?=[ .(-])", body)
                    take(start, end, kind, norm, country[1] if country else "")
            else:
                start, end = m.span("v2" if kind == "name" else "v3")
                title = m["title"] if kind == "name" else ""
                words = []
                for w in re.finditer(NAME, text[start:end]):
                    if w[0][0].islower():
                        break
                    words.append(w)
                gender = "m" if title in MALE else "f" if title in FEMALE else ""
                for at, w in enumerate(words):
                    given = at < len(words) - 1 or w[0].lower() in GENDER
                    sex = GENDER.get(w[0].lower(), gender) if given else ""
                    take(start + w.start(), start + w.end(), "given" if given else "surname", w[0].lower(), sex)
    # A name that was found once is a name wherever the text has it again, with or without a title.
    names = {norm: (kind, detail) for _, _, kind, norm, detail in found if kind in ("given", "surname")}
    for m in re.finditer(NAME, text) if names else ():
        whole = [m] if m[0].lower() in names else LETTER_RUN.finditer(text, m.start(), m.end())
        for w in whole:
            if w[0].lower() in names and not w[0][0].islower():
                take(w.start(), w.end(), names[w[0].lower()][0], w[0].lower(), names[w[0].lower()][1])
    return sorted(found)


# --- surrogates ----------------------------------------------------------------------------


class Draw:
    """A keyed stream of choices."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.key, self.seed, self.block, self.pool = key, f"{kind}\0{norm}\0{attempt}\0".encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.digest(self.key, self.seed + str(self.block).encode(), "sha256")
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def pick(self, options):
        return options[self.below(len(options))]


def script(c: str) -> str:
    """``latin``, ``cyrillic``, ``greek`` or ``other``."""
    name = unicodedata.name(c, "LATIN").split(" ")[0].lower()
    return name if name in LETTERS else "other"


# Letters of a script, vowels first.
LETTERS = {
    "latin": ("aeiou", "bcdfghklmnprstvwz"),
    "cyrillic": ("аеиоу", "бвгдзклмнпрст"),
    "greek": ("αεηιου", "βγδζθκλμνπρστ"),
}


def like_letter(c: str, draw: Draw) -> str:
    """A letter of the same script, sort and case."""
    if script(c) == "other":
        # A letter of the same sort among its 128 neighbours; the letter itself is always one of them.
        near = [n for n in map(chr, range(ord(c) & ~127, (ord(c) & ~127) + 128)) if unicodedata.category(n) == unicodedata.category(c)]
        return draw.pick(near)
    vowels, others = LETTERS[script(c)]
    plain = unicodedata.normalize("NFD", c.lower())[0]
    new = draw.pick(vowels if plain in vowels else others)
    return new.upper() if c.isupper() else new


def like_text(text: str, draw: Draw) -> str:
    return "".join(str(draw.below(10)) if c.isdigit() else like_letter(c, draw) if c.isalpha() else c for c in text)


def digits(n: int, draw: Draw, first: str = "") -> str:
    return first + "".join(str(draw.below(10)) for _ in range(n - len(first)))


def surrogate(kind: str, norm: str, detail: str, attempt: int, key: bytes = KEY) -> str:
    """The normal form of the stand-in."""
    draw = Draw(key, kind, norm, attempt)
    if kind == "email":
        local, _, domain = norm.partition("@")
        labels = domain.split(".")
        return like_text(local, draw) + "@" + ".".join([*(like_text(x, draw) for x in labels[:-1]), labels[-1]])
    if kind == "secret":
        if all(c in "0123456789abcdefABCDEF" for c in norm):
            low = "0123456789abcdef" if norm.lower() == norm else "0123456789ABCDEF"
            return "".join(draw.pick(low) for _ in norm)
        return like_text(norm, draw)
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in norm[4:])
        return norm[:2] + f"{98 - mod97(norm[:2] + '00' + body):02d}" + body
    if kind == "ip":
        parts = [int(p) for p in norm.split(".")]
        private = parts[0] == 10 or parts[:2] == [192, 168] or parts[0] == 172 and 16 <= parts[1] < 32 or parts[0] in (0, 127)
        keep = (2 if parts[:2] == [192, 168] or parts[0] == 172 else 1) if private else 0
        new = [*parts[:keep], *(draw.below(256) for _ in range(4 - keep))]
        if not keep:
            new[0] = draw.pick([n for n in range(1, 224) if n not in (10, 100, 127, 169, 172, 192, 198, 203)])
        return ".".join(map(str, new))
    if kind == "card":
        new = digits(len(norm), draw, norm[0])
        ends = [new[:-1] + d for d in "0123456789"]
        return draw.pick([n for n in ends if str(luhn(n)) == detail])
    if kind in ("ssn", "phone"):
        return digits(len(norm), draw, detail or ("0" if norm[0] == "0" else str(1 + draw.below(9))))
    if kind == "given":
        kind_of = script(norm[0])
        if kind_of == "other":
            return like_text(norm + norm[: max(0, attempt - 4) // 4], draw)
        names = GIVEN[kind_of, detail] if detail else [n for k, v in GIVEN.items() if k[0] == kind_of for n in v]
        name = draw.pick(names).lower()
        # Past the known names, letters are added so that people stay distinct.
        return name if attempt < 3 else name + like_text(norm[: min(2 + attempt // 4, len(norm) + 8)] or norm, draw)
    return like_text(norm + norm[: max(0, attempt - 4) // 4], draw)


def rendered(mention: str, kind: str, new: str) -> str:
    """The surrogate in the form of a mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        rest = iter(new)
        return "".join(next(rest) if c.isalnum() else c for c in mention)
    if kind in ("secret", "ip"):
        return new
    if mention.isupper():
        return new.upper()
    if kind == "email":
        # Cases follow the mention, letter by letter.
        return "".join(n.upper() if m.isupper() else n for m, n in zip(mention, new)) + new[len(mention) :]
    return "".join(n.upper() if at == 0 or new[at - 1] in "-'’" else n for at, n in enumerate(new)) if mention[0].isupper() else new


def rewritten(text: str, mentions, new: dict[tuple[str, str], str]) -> str:
    out, at = [], 0
    for start, end, kind, norm in mentions:
        out += [text[at:start], rendered(text[start:end], kind, new[kind, norm])]
        at = end
    return "".join([*out, text[at:]])


# --- jobs ----------------------------------------------------------------------------------

MENTIONS = T.ArrayType(
    T.StructType([T.StructField(n, T.IntegerType() if n in ("start", "end") else T.StringType()) for n in ("start", "end", "kind", "norm", "detail")])
)


def detected(docs: DataFrame, text: str, with_entities: bool, name: str = "_mentions") -> DataFrame:
    """``docs`` rows with (or without) entities; with them also the column ``name``."""
    names, at = docs.columns, docs.columns.index(text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("norm", pa.string()),
                                   ("detail", pa.string())]))
        for batch in batches:
            bodies = (b.as_py() or "" for b in batch.column(at))
            found = [entities(b) if may_hold(b) else [] for b in bodies]
            take = pa.array([i for i, f in enumerate(found) if bool(f) == with_entities], pa.int32())
            rows = batch.take(take)
            if with_entities:
                keys = ("start", "end", "kind", "norm", "detail")
                lists = pa.array([[dict(zip(keys, e, strict=True)) for e in f] for f in found if f], kind)
                rows = pa.RecordBatch.from_arrays([*rows.columns, lists], [*names, name])
            yield rows if with_entities else rows.rename_columns(names)

    schema = T.StructType([*docs.schema.fields])
    # Numbers for names on the way in: a name may hold a dot.
    numbered = docs.toDF(*map(str, range(len(docs.columns))))
    return numbered.mapInArrow(find, schema.add(name, MENTIONS) if with_entities else schema)


def assigned(entities_: DataFrame, key: bytes = KEY) -> DataFrame:
    """``kind, norm, new`` for distinct ``kind, norm, detail``: no two alike, none an entity of the corpus."""

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, norm: pd.Series, detail: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(*row, key) for row in zip(kind, norm, detail, attempt, strict=True)], dtype=object)

    rows = entities_.groupBy("kind", "norm").agg(F.max("detail").alias("detail"))
    rows = staged(rows.withColumn("attempt", F.lit(0)).withColumn("new", drawn("kind", "norm", "detail", F.lit(0))))
    while True:
        first = rows.groupBy("kind", "new").agg(F.min("norm").alias("_first"))
        real = rows.select("kind", F.col("norm").alias("new"), F.lit(True).alias("_real"))
        marked = rows.join(first, ["kind", "new"]).join(real, ["kind", "new"], "left")
        marked = marked.withColumn("_clash", F.col("_real").isNotNull() | (F.col("norm") != F.col("_first")))
        again = F.col("attempt") + F.col("_clash").cast("int")
        marked = staged(marked.select("kind", "norm", "detail", "new", "_clash", again.alias("attempt")))
        if not marked.where("_clash").limit(1).count():
            return marked.select("kind", "norm", "new")
        redrawn = marked.where("_clash").withColumn("new", drawn("kind", "norm", "detail", "attempt"))
        rows = staged(marked.where("not _clash").unionByName(redrawn).drop("_clash"))


def pseudonymized(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the column ``n_entities``, or ``n_entities_`` if there is one of that name."""
    given, counted = docs.columns, unused(docs.columns, "n_entities")
    found_, row_, new_ = (unused([*given, counted], name) for name in ("_mentions", "_row", "_new"))
    hit = staged(detected(docs, text, True, found_).withColumn(row_, F.monotonically_increasing_id()))
    mentions = hit.select(F.col(row_).alias("_row"), F.posexplode(found_).alias("_at", "m")).select("_row", "_at", "m.*")
    new = assigned(mentions.select("kind", "norm", "detail"), key)
    # Copies of a document share their entities: a mention finds its surrogate in a join that the runtime can split.
    pairs = mentions.select("_row", "kind", "norm").distinct().join(new, ["kind", "norm"])
    lists = pairs.groupBy("_row").agg(F.collect_list(F.struct("kind", "norm", "new")).alias(new_))

    @F.pandas_udf("string")
    def replaced(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found, table_ in batches:
            out = []
            for body, ms, pairs_ in zip(texts, found, table_, strict=True):
                known = {(p["kind"], p["norm"]): p["new"] for p in pairs_}
                out.append(rewritten(body, [(m["start"], m["end"], m["kind"], m["norm"]) for m in ms], known))
            yield pd.Series(out, dtype=object)

    changed = (
        hit.join(lists.withColumnRenamed("_row", row_), row_)
        .withColumn(counted, F.size(found_).cast("long"))
        .withColumn(text, replaced(text, found_, new_))
        .select(*named([*given, counted]))
    )
    return detected(docs, text, False).withColumn(counted, F.lit(0).cast("long")).unionByName(changed)


def op4_pii_surrogates(spark, sf_dir):
    """Every document with its rewritten text."""
    return pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"))


