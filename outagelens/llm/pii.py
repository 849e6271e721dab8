"""PII: detected entities get keyed surrogates of the same type, gender, script and format.

Entities: e-mail addresses, IPv4 addresses, payment card numbers, phone numbers, social security numbers, IBANs, access
keys, values after ``password=``, ``token =`` and the like, and names after a title (whose gender the title tells).
Each has a canonical form (digits without separators, lower case), so spellings of one entity have one surrogate in all
documents; the surrogate is poured into the format of each mention. Name parts have surrogates of their own, and a
part found with a title is also replaced where it stands alone in that text, so references agree.

A surrogate is drawn from HMAC-SHA-256 of key, type, canonical form and attempt. Collision check: all distinct
entities get one for attempt 0; those whose surrogate another entity has (the smallest canonical form keeps it), or that is
itself an entity of the corpus, draw again until all are distinct. From the eighth attempt the surrogate grows
longer, so this ends. Only entities beyond attempt 0 must be looked up: if they are ``BROADCAST_ROWS`` or fewer
they are broadcast, else each document is joined to its own.

Edge cases: a null text stays null, texts without entities are unchanged; repeated rows and null doc_ids are treated row by
row; other columns are kept; empty tables work.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagelens.llm.common import others, stored, table

KEY = b"outagelens-surrogates"
BROADCAST_ROWS = 50_000
GROW_AT = 8

#: fixed values: titles by the gender they tell
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Señor": "m", "Sr": "m", "Monsieur": "m",
          "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Señora": "f", "Sra": "f", "Madame": "f", "Mme": "f",
          "Господин": "m", "Госпожа": "f", "Dr": "n", "Prof": "n"}
#: fixed values: letters and endings of made-up names by script; the endings tell the gender
SCRIPTS = {
    "latin": ("bdfgklmnprstvz", "aeiou", {"f": "a", "m": "o", "n": "e"}),
    "cyrillic": ("бдгклмнпрств", "аеиоу", {"f": "а", "m": "", "n": "и"}),
    "greek": ("βδγκλμνπρστ", "αεηιο", {"f": "α", "m": "ος", "n": "ης"}),
}

_NAME = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-Я][a-zà-öø-ÿα-ωάέήίόύώςа-я]+"
PATTERNS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"\b(?:AKIA|ASIA)[A-Z0-9]{16,}\b"),
    ("assigned", r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\s?[=:]\s?[\"']?)(?P<value>[^\s\"',;]{4,})"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("card", r"(?<![\d-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])"),
    ("phone", r"(?<![\d.\w])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\d-])|(?<![\d.\w])\+\d{8,14}(?!\d)"),
    ("name", rf"\b(?P<title>{'|'.join(TITLES)})\.? (?P<who>{_NAME}(?: {_NAME}){{0,2}})"),
]
FINDER = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS))
#: a text without any of these has no entity
MAYBE = r"[\p{Nd}@]|AKIA|ASIA|(?i:password|passwd|pwd|secret|token|api[_-]?key)|(?:" + "|".join(TITLES) + r")\.? "


def script_of(word: str) -> str:
    return "greek" if re.search("[α-ωΑ-Ω]", word) else "cyrillic" if re.search("[а-яА-Я]", word) else "latin"


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


class Draw:
    """An endless keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: bytes, *what: object):
        seed = hmac.digest(key, "\0".join(map(str, what)).encode(), "sha256")
        self.stream = (b for i in range(1 << 30) for b in hashlib.sha256(seed + i.to_bytes(4, "big")).digest())

    def below(self, n: int) -> int:
        value = 0
        for _ in range(6):
            value = value << 8 | next(self.stream)
        return value % n

    def of(self, choices: str) -> str:
        return choices[self.below(len(choices))]

    def like(self, text: str) -> str:
        """Each digit and letter replaced by one of its kind (hexadecimal strings stay such)."""
        lower = "abcdef" if re.fullmatch("[0-9a-f]{8,}", text) else "abcdefghijklmnopqrstuvwxyz"
        return "".join(self.of("0123456789") if c.isdigit() else self.of(lower) if c.isascii() and c.islower()
                       else self.of(lower.upper()) if c.isascii() and c.isupper() else c for c in text)


@lru_cache(maxsize=100_000)
def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of the surrogate."""
    draw, more = Draw(key, kind, canonical, attempt), max(0, attempt - GROW_AT + 1)
    if kind == "email":
        local, _, domain = canonical.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{draw.like(local + 'x' * more)}@{draw.like(host)}.{top}"
    if kind == "ip":
        bounds = {1: (1, 10), 2: (10, 100), 3: (100, 224)}
        parts = [draw.below(hi - lo) + lo for lo, hi in (bounds[min(3, len(p) + more)] for p in canonical.split("."))]
        return ".".join(map(str, parts))
    if kind == "card":
        body = canonical[0] + draw.like(canonical[1:-1] + "0" * more)
        ends = [d for d in "0123456789" if luhn(body + d) == luhn(canonical)]
        return body + ends[draw.below(len(ends))]
    if kind == "phone":
        # a country code, given with a plus, stays; no number begins with 0 or 1 after it
        code, rest = re.fullmatch(r"((?:\+\d{1,3} )?)(\d+)", canonical).groups()
        return code + str(2 + draw.below(8)) + draw.like(rest[1:] + "0" * more)
    if kind == "ssn":
        return str(1 + draw.below(8)) + draw.like(canonical[1:] + "0" * more)
    if kind == "iban":
        return canonical[:2] + draw.like(canonical[2:] + "0" * more)
    if kind.startswith("name-"):
        consonants, vowels, ends = SCRIPTS[script_of(canonical)]
        body = "".join(draw.of(consonants) + draw.of(vowels) for _ in range(max(2, len(canonical) // 2) + more))
        return body + draw.of(consonants) + ends[kind[-1]]
    # an access key's first letters tell its type
    kept = 4 if re.fullmatch("A[KS]IA[A-Z0-9]{16,}", canonical) else 0
    return canonical[:kept] + draw.like(canonical[kept:] + ("0" if kept else "x") * more)


def canonical(kind: str, text: str) -> str:
    if kind == "email":
        return text.lower()
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "phone":
        m = re.match(r"\+(\d{1,3})[ .(-]", text)
        digits = re.sub(r"\D", "", text)
        return f"+{m[1]} {digits[len(m[1]):]}" if m and len(digits) > len(m[1]) else digits
    if kind == "iban":
        return text.replace(" ", "")
    return text.lower() if kind.startswith("name-") else text


def poured(kind: str, mention: str, new: str) -> str:
    """A surrogate's canonical form in the format of a mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        chars = iter(new.replace("+", "").replace(" ", ""))
        out = "".join(next(chars, "") if c.isalnum() else c for c in mention)
        return out + "".join(chars)
    if mention.isupper() and len(mention) > 1:
        return new.upper() if kind == "email" or kind.startswith("name-") else new
    return new.capitalize() if kind.startswith("name-") and mention[0].isupper() else new


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """from, to, kind and canonical form of every mention, in order."""
    out, parts = [], {}
    for m in FINDER.finditer(text):
        kind = next(k for k, _ in PATTERNS if m[k] is not None)
        if kind == "name":
            gender, at = TITLES[m["title"]], m.start("who")
            words = m["who"].split(" ")
            for i, w in enumerate(words):
                what = f"name-given-{gender}" if i + 1 < len(words) else "name-family-n"
                out.append((at, at + len(w), what, canonical(what, w)))
                parts.setdefault(w, what)
                at += len(w) + 1
            continue
        at, to = m.span("value" if kind == "assigned" else kind)
        kind = "secret" if kind == "assigned" else kind
        out.append((at, to, kind, canonical(kind, text[at:to])))
    if parts:
        taken = {(s, e) for s, e, _, _ in out}
        for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, parts)) + r")\b", text):
            if not any(s < m.end() and m.start() < e for s, e in taken):
                out.append((*m.span(), parts[m[0]], canonical(parts[m[0]], m[0])))
        out.sort()
    return out


def _candidates(texts: pa.Array) -> list[str | None]:
    """The texts that may have entities; None for the others."""
    maybe = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False)
    return pc.if_else(maybe, texts, pa.scalar(None, texts.type)).to_pylist()


@F.arrow_udf(T.ArrayType(T.StructType().add("kind", T.StringType()).add("entity", T.StringType())))
def entities_in(texts: pa.Array) -> pa.Array:
    out = [[] if t is None else [{"kind": k, "entity": c} for k, c in sorted({x[2:] for x in mentions(t)})] for t in _candidates(texts)]
    return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string())])))


def later_attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, entity and attempt of the ``entities`` (distinct) that need another attempt than 0 to stay distinct."""
    @F.arrow_udf("string")
    def draw(kinds: pa.Array, names: pa.Array, attempts: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, *x) for x in zip(kinds.to_pylist(), names.to_pylist(), attempts.to_pylist(), strict=True)], pa.string())

    spark, attempt = entities.sparkSession, 0
    real = entities.select("kind", F.col("entity").alias("new"))
    asked, used, fixed = entities, None, None
    while True:
        drawn = stored(asked.withColumn("attempt", F.lit(attempt)).withColumn("new", draw("kind", "entity", "attempt")), "surrogates")
        # taken by an entity of the corpus, or by a surrogate of an earlier round
        blocked = real if used is None else real.union(used.select("kind", "new"))
        free = drawn.join(blocked.distinct(), ["kind", "new"], "left_anti")
        best = stored(free.groupBy("kind", "new").agg(F.min("entity").alias("entity")), "surrogates-kept")
        lost = stored(drawn.join(best, ["kind", "new", "entity"], "left_anti").select("kind", "entity"), "surrogates-lost")
        used = best if used is None else used.unionByName(best)
        if attempt:
            own = best.select("kind", "entity", F.lit(attempt).alias("attempt"))
            fixed = own if fixed is None else fixed.union(own)
        if lost.isEmpty():
            break
        asked, attempt = lost, attempt + 1
    return fixed if fixed is not None else spark.createDataFrame([], "kind string, entity string, attempt int")


REPLACED = "struct<text: string, n_entities: long>"


def with_surrogates(docs: DataFrame, key: bytes = KEY, column: str = "text") -> DataFrame:
    """``docs`` with ``column`` replaced and n_entities (mentions replaced) appended."""
    spark = docs.sparkSession
    found = stored(docs.select("doc_id", entities_in(F.col(column).cast("string")).alias("e")).where(F.size("e") > 0)
                   .select("doc_id", F.inline("e")), "entities")
    extra = stored(later_attempts(found.select("kind", "entity").distinct(), key), "attempts")
    small = extra.count() <= BROADCAST_ROWS
    known = spark.sparkContext.broadcast({(k, e): a for k, e, a in map(tuple, extra.collect())} if small else {})
    kind = pa.struct([("text", pa.string()), ("n_entities", pa.int64())])

    def replace(text: str | None, attempts: dict) -> tuple[str | None, int]:
        if text is None:
            return None, 0
        out, at, n = [], 0, 0
        for s, e, what, name in mentions(text):
            new = surrogate(key, what, name, attempts.get((what, name), 0))
            out += [text[at:s], poured(what, text[s:e], new)]
            at, n = e, n + 1
        return "".join([*out, text[at:]]), n

    @F.arrow_udf(REPLACED)
    def change(texts: pa.Array, own: pa.Array) -> pa.Array:
        rows = []
        for t, mine in zip(_candidates(texts), own.to_pylist(), strict=True):
            rows.append(replace(t, known.value if mine is None else {(x["kind"], x["entity"]): x["attempt"] for x in mine}))
        new = pa.array([t for t, _ in rows], pa.string())
        return pa.StructArray.from_arrays([pc.coalesce(new, texts), pa.array([n for _, n in rows], pa.int64())], fields=list(kind))

    kind_of = "array<struct<kind: string, entity: string, attempt: int>>"
    rest = others(docs, column, "n_entities")
    rows = docs
    if small:
        rows = rows.withColumn("__own", F.lit(None).cast(kind_of))
    else:
        mine = (found.join(extra, ["kind", "entity"]).distinct().groupBy(F.col("doc_id").alias("__id"))
                .agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("__own")))
        rows = rows.join(mine, F.col("doc_id").eqNullSafe(F.col("__id")), "left").withColumn(
            "__own", F.coalesce("__own", F.array().cast(kind_of)))
    rows = rows.withColumn("__new", change(F.col(column).cast("string"), "__own"))
    return rows.select(*rest, F.col("__new.text").alias(column), F.col("__new.n_entities").alias("n_entities"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_pii": (op9_pii, None)}
