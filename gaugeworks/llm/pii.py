"""Surrogates for personal data: keyed, type-consistent and distinct.

Entities are found by patterns and normalised, so that one entity written in several ways is one. Each
distinct entity of the corpus draws a surrogate from a keyed hash: of its type, script, gender and
format, digit for digit and letter for letter. Two entities must never share a surrogate, and no
surrogate may be an entity of the corpus: a grouped check finds both, and who loses draws again. The
surrogates then replace every mention, in the mention's own form.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import cut, restored, sheltered, written

# Given names by script and gender, titles by gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Carmen Clara Elena Emma Helen Ingrid Julia Laura Lucia Maria Marie Martha Nina Paula Rosa Sarah Sofia Susan".split(),
    ("latin", "m"): "Albert Carlos Daniel David Felix Frank George Hans Jean John Jorge Lucas Luis Martin Michael Oscar Paul Peter Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Наталья Ольга Светлана".split(),
    ("cyrillic", "m"): "Алексей Борис Дмитрий Иван Михаил Николай Сергей Юрий".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Mme Mlle Madame Sra Srta Señora г-жа κα".split(), "m": "Mr Herr Monsieur Sr Señor г-н κος".split(), "": "Dr Prof".split()}

NAME = r"\p{Lu}\p{L}+(?:[-'’]\p{Lu}\p{L}+)*"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_GIVEN = "|".join(sorted((n for ns in GIVEN.values() for n in ns), key=len, reverse=True))
#: What is found, in order of preference where two begin at one place.
FOUND = regex.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<secret>(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*)(?P<value>[^\s,;\"']{6,})|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}\b|\bsk-[A-Za-z0-9_-]{20,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<six>(?<![\w:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-](?:\(?\d{1,4}\)?[ .-])?\d{3,8}(?:[ .-]\d{2,8}){0,4}(?!\w)|(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\w)|(?<![\w+])(?:\+\d|0)\d{7,14}(?!\w))"
    rf"|(?P<person>\b(?:(?P<title>{_TITLE})\.?[ ]+(?P<name>{NAME}(?:[ ]+{NAME}){{0,2}})|(?P<full>(?:{_GIVEN})(?:[ ]+{NAME}){{1,2}})))"
)
#: First letters of titles and listed names, those that are small, and what follows each.
_FIRST = sorted({n[0] for names in (*TITLES.values(), *GIVEN.values()) for n in names})
_SMALL = "".join(c for c in _FIRST if c.islower())
_REST = "|".join(f"(?<={c})(?:{'|'.join(n[1:] for n in f'{_TITLE}|{_GIVEN}'.split('|') if n[0] == c)})" for c in _FIRST)
#: A text that this doesn't match has no entity and no pair; Spark applies it before texts go to Python. It has no word
#: bounds, which Java may read as ASCII's only. Java tries all alternatives at each character, so there are none before
#: one class of characters, few of plain prose; titles and names are read only where a space and no small letter follow.
MAYBE = (
    rf"[0-9@=:_\-\p{{Lu}}{_SMALL}](?:(?<=[0-9@=:])"
    rf"|(?=[\p{{L}}-]++\.? +\P{{Ll}})(?:(?<![_\-{_SMALL}])\p{{Ll}}+ \p{{Lu}}\p{{Ll}}|{_REST})"
    r"|(?<=A)KIA|(?<=gh[pousr]_|sk-))"
)
#: Where an entity can begin, by patterns that skip fast over plain prose; mail addresses and named secrets are
#: traced back from their sign.
BEGINS = [re.compile(x) for x in (r"[+(]|\d+", r"[A-Z]{2}\d{2}", r"AKIA|gh[pousr]_|sk-", f"{_TITLE}|{_GIVEN}")]
SIGN = re.compile("[@=:]")
LOCAL = re.compile(r"[\w.+-]")
WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key")
HEX = "0123456789abcdefABCDEF"
#: Two capitalised words in a row, and any capitalised word.
PAIR = regex.compile(r"(?<![\p{L}'’-])\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+(?![\p{L}'’-])")
#: What a sentence begins after.
BEFORE = ".!?:;\n\r\t\"“”«»()[]|"
WORD = regex.compile(rf"(?<![\p{{L}}'’-]){NAME}(?![\p{{L}}'’-])")
#: What the pattern of telephone numbers also finds.
DATE = re.compile(r"(?:19|20)\d\d[ .-]\d\d[ .-]\d\d|\d\d[ .-]\d\d[ .-](?:19|20)\d\d")
#: Groups as of any large number or list of numbers, which only a word before them tells to be a telephone's.
BARE = re.compile(r"[1-9]\d{0,3}(?: \d{3}){1,4}")
CUE = re.compile(r"(?:tel|phone|fax|call|mobile|cell|whatsapp|dial|m[oó]vil|tél|тел|τηλ)\w*\W{0,4}(?:\w+\W{1,3}){0,2}$", re.IGNORECASE)
#: Attempts after which surrogates grow longer, and after which none is expected any more.
ROOMY, MOST_ATTEMPTS = 12, 400
#: First numbers of public addresses.
PUBLIC = [n for n in range(1, 224) if n not in (10, 100, 127, 169, 172, 192, 198, 203)]
ADDED = ("n_entities",)
#: What tells the issuer of a secret, and stays.
MARK = regex.compile(r"AKIA|gh[pousr]_|sk-")
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def script_of(text: str) -> str:
    """latin, cyrillic or greek, by the first letter."""
    for c in text:
        if c.isalpha():
            name = unicodedata.name(c, "LATIN").split(" ")[0].lower()
            return name if name in LETTERS else "latin"
    return "latin"


def gender_of(name: str) -> str:
    return next((g for (_, g), names in GIVEN.items() if name in names), "")


def begins(text: str) -> list[int]:
    """All places where ``FOUND`` can match, in order, and few others."""
    at = {m.start() for x in BEGINS for m in x.finditer(text)}
    done = 0
    for m in SIGN.finditer(text):
        i = m.start()
        if m[0] == "@":
            while i > done and LOCAL.match(text, i - 1):
                i -= 1
            at.add(i)
            done = m.end()
            continue
        if m[0] == ":":
            while i and m.start() - i < 4 and text[i - 1] in HEX:
                i -= 1
            at.add(i)
            i = m.start()
        while i and text[i - 1].isspace():
            i -= 1
        before = text[max(0, i - 8) : i].lower()
        at |= {i - len(w) for w in WORDS if before.endswith(w)}
    return sorted(at)


def found(text: str) -> Iterator[regex.Match]:
    """The matches of ``FOUND.finditer(text)``, tried only where one can begin."""
    end = 0
    for at in begins(text):
        if at >= end and (m := FOUND.match(text, at)):
            end = m.end()
            yield m


def _six(text: str) -> str | None:
    """An IPv6 address in its shortest form, or None if it is none."""
    try:
        return ipaddress.IPv6Address(text).compressed
    except ValueError:
        return None


def _person(text: str, at: int, title: str | None) -> Iterator[tuple[int, int, str, str]]:
    """A mention for each name of ``text``, which begins at ``at``; the last is the surname where there are two or a title."""
    sex = next((s for s, ts in TITLES.items() if title in ts), "") if title else ""
    names = list(regex.finditer(NAME, text))
    for i, n in enumerate(names):
        last = i == len(names) - 1 and (len(names) > 1 or title)
        yield at + n.start(), at + n.end(), f"{'surname' if last else 'given'}:{script_of(n[0])}:{'' if last else gender_of(n[0]) or sex}", n[0].lower()


def pairs(text: str) -> Iterator[tuple[int, int, str, str]]:
    """``(start, end, norm, scripts)`` of two capitalised words in a row, which may be a person; ``norm`` begins with ``^`` where they begin a
    sentence, as any word is capitalised there. ``scripts`` names those of both words, as ``script_of`` tells them."""
    for m in PAIR.finditer(text):
        i = m.start() - 1
        while i >= 0 and text[i] == " ":
            i -= 1
        yield m.start(), m.end(), ("^" if i < 0 or text[i] in BEFORE else "") + m[0].lower(), " ".join(map(script_of, m[0].split(" ")))


def mentions(text: str, confirmed: frozenset[str] | set[str] = frozenset()) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, norm)`` of each mention, in order; a person gives one for each name.

    ``confirmed`` are the capitalised pairs that are persons. A name that a person of this text has is a mention
    also where it stands alone. A secret without a letter or digit, as a mask is, and a date are none.
    """
    out: list[tuple[int, int, str, str]] = []
    for m in found(text):
        whole, at = m[0], m.start()
        if m["phone"]:
            digits = "".join(c for c in whole if c.isdigit())
            bare = BARE.fullmatch(whole) and not CUE.search(text, max(0, at - 40), at)
            if 8 <= len(digits) <= 15 and not DATE.fullmatch(whole) and not bare:
                out.append((at, m.end(), "phone", ("+" if whole[0] == "+" else "") + digits))
        elif m["card"] or m["ssn"]:
            out.append((at, m.end(), "card" if m["card"] else "ssn", "".join(c for c in whole if c.isdigit())))
        elif m["iban"]:
            out.append((at, m.end(), "iban", whole.replace(" ", "")))
        elif m["secret"]:
            g = "value" if m["value"] else 0
            mark = MARK.match(m[g])
            if any(c.isalnum() for c in m[g][mark.end() if mark else 0 :]):
                out.append((m.start(g), m.end(g), "secret", m[g]))
        elif m["person"]:
            g = "name" if m["name"] else "full"
            out += _person(m[g], m.start(g), m["title"])
        elif m["six"]:
            if norm := _six(whole):
                out.append((at, m.end(), "ip", norm))
        else:
            out.append((at, m.end(), "email" if m["email"] else "ip", whole.lower()))
    if confirmed:
        spans = [(a, b) for a, b, *_ in out]
        for a, b, norm, _ in pairs(text):
            if norm in confirmed and not any(x < b and a < y for x, y in spans):
                out += _person(text[a:b], a, None)
    known = {norm: kind for _, _, kind, norm in out if ":" in kind}
    if known:
        taken = {a for a, *_ in out}
        spans = sorted((a, b) for a, b, *_ in out)
        ends = [b for _, b in spans]
        for m in WORD.finditer(text):
            if (kind := known.get(m[0].lower())) and m.start() not in taken:
                k = bisect.bisect_right(ends, m.start())
                if k == len(spans) or spans[k][0] >= m.end():
                    out.append((m.start(), m.end(), kind, m[0].lower()))
    return sorted(out)


def base(kind: str) -> str:
    """A kind without the gender, which is settled for each name over the whole corpus."""
    return kind.rpartition(":")[0] if ":" in kind else kind


class Draws:
    """A stream of small numbers fixed by key, entity and attempt."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{norm}\0{attempt}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n

    def like(self, text: str) -> str:
        """``text`` with digits for digits and letters for letters of its script and case; the rest stays."""
        out = []
        for c in text:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                letters = LETTERS[script_of(c)]
                d = letters[self.below(len(letters))]
                out.append(d.upper() if c.isupper() else d)
            else:
                out.append(c)
        return "".join(out)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def _address(norm: str, attempt: int, draw: Draws) -> str:
    """An address for one: private for private, as many bits of a well-known prefix; version 6 where few are left of version 4."""
    address = ipaddress.ip_address(norm)
    if address.version == 4 and attempt < ROOMY:
        first = [int(x) for x in norm.split(".")]
        kept = (1 if first[0] in (10, 127) else 2) if address.is_private else 0
        if kept and attempt >= ROOMY // 2:
            first, kept = [10], 1
        head = first[:kept] or [PUBLIC[draw.below(len(PUBLIC))]]
        return ".".join(map(str, [*head, *(1 + draw.below(254) for _ in range(4 - len(head)))]))
    head = norm.split(":")[0] if address.version == 6 and address.is_private and not norm.startswith(":") else "fd00" if address.is_private else "2001:db8"
    groups = [f"{1 + draw.below(0xFFFE):x}" for _ in range(8 - len(head.split(":")))]
    return ipaddress.IPv6Address(":".join([*head.split(":"), *groups])).compressed


def surrogate(kind: str, norm: str, attempt: int, key: bytes) -> str:
    """The surrogate that an entity draws at an attempt, in normal form; it is longer after many, so that none runs out."""
    draw = Draws(key, kind, norm, attempt)
    extra = max(0, attempt - ROOMY + 4) // 4
    digits = lambda: "".join(str(draw.below(10)) for _ in range(extra))
    letters = lambda n, script="latin": "".join(LETTERS[script][draw.below(len(LETTERS[script]))] for _ in range(n))
    if kind == "email":
        local, _, host = norm.rpartition("@")
        labels = host.split(".")
        kept = 2 if labels[-2:] in (["example", "com"], ["example", "org"], ["example", "net"]) else 1
        if len(labels) <= kept:
            kept = 1
        return draw.like(local) + letters(attempt // 3) + "@" + ".".join([*map(draw.like, labels[:-kept]), *labels[-kept:]])
    if kind == "phone":
        plus = norm.startswith("+")
        kept = (2 if norm[1] in "17" else 3) if plus else 0
        body = draw.like(norm[kept:])
        if len(body) == 10 and norm[kept + 3 : kept + 6] == "555":  # numbers for fiction stay such
            body = body[:3] + "555" + body[6:]
        return norm[:kept] + body + digits()
    if kind == "ip":
        return _address(norm, attempt, draw)
    if kind == "card":
        new = norm[0] + draw.like(norm[1:]) + digits()
        valid = _luhn(norm) == 0
        last = next(str(d) for d in range(10) if (_luhn(new[:-1] + str(d)) == 0) == valid)
        return new[:-1] + last if valid or _luhn(new) == 0 else new
    if kind == "iban":
        body = draw.like(norm[4:]) + digits()
        value = int("".join(str(int(c, 36)) for c in body + norm[:2] + "00"))
        return f"{norm[:2]}{98 - value % 97:02d}{body}"
    if kind == "secret":
        mark = MARK.match(norm)
        head = mark[0] if mark else ""
        return head + draw.like(norm[len(head) :]) + letters(extra)
    if kind.startswith("given:"):
        _, script, sex = kind.split(":")
        pool = GIVEN[script, sex] if sex else GIVEN[script, "f"] + GIVEN[script, "m"]
        # compound names once single ones are taken, so that gender and script hold for any number of entities
        return "-".join(pool[draw.below(len(pool))] for _ in range(1 + attempt // 2)).lower()
    if kind.startswith("surname:"):
        return draw.like(norm) + letters(max(extra, 3 - len(norm) if attempt else 0), kind.split(":")[1])
    return draw.like(norm) + digits()


def shown(kind: str, mention: str, new: str) -> str:
    """A surrogate in the form of the mention that it replaces: its separators and its case."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(new.lstrip("+"))
        return "".join(next(chars, "") if c.isalnum() else c for c in mention) + "".join(chars)
    if kind == "secret" or kind == "ip":
        return new
    if mention.isupper():
        return new.upper()
    return new.title() if kind.startswith(("given", "surname")) else new


def assigned(entities: DataFrame, key: str, draw: Callable[[str, str, int, bytes], str] = surrogate) -> DataFrame:
    """``(kind, norm, new)`` for distinct ``(kind, norm)``: distinct surrogates, none of which is an entity or stays as it was.

    Kinds of names share one space, so that a surname's surrogate is no other's given name. Of entities that
    draw the same surrogate, the least by a hash keeps it and the others draw again, until none is left. Draws
    grow longer with the attempts, so that each round settles more; a ``draw`` that never does raises after
    ``MOST_ATTEMPTS``.
    """
    secret = key.encode()
    spark = entities.sparkSession

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["new"] = [draw(k, n, int(a), secret) for k, n, a in zip(f.kind, f.norm, f.attempt)]
            yield f[["kind", "norm", "attempt", "new"]]

    space = lambda c: F.when(F.col(c).contains(":"), "name").otherwise(F.col(c))
    entities = cut(entities.distinct())
    real = entities.select(space("kind").alias("space"), F.col("norm").alias("new")).distinct()
    done = spark.createDataFrame([], "space string, new string, kind string, norm string")
    waiting = entities.withColumn("attempt", F.lit(0))
    for _ in range(MOST_ATTEMPTS):
        drawn = cut(waiting.mapInPandas(kernel, "kind string, norm string, attempt int, new string").withColumn("space", space("kind")))
        free = drawn.join(real, ["space", "new"], "left_anti").join(done, ["space", "new"], "left_anti")
        rank = F.struct(F.xxhash64("kind", "norm"), "kind", "norm")
        won = free.groupBy("space", "new").agg(F.min(rank).alias("x")).select("space", "new", "x.kind", "x.norm")
        done = written(done.unionByName(won), "surrogates")
        waiting = written(drawn.join(done, ["kind", "norm"], "left_anti").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), "waiting")
        if waiting.isEmpty():
            return done.select("kind", "norm", "new")
    raise RuntimeError("some entities find no surrogate of their own")


def with_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in its text, and ``n_entities``, the number of mentions replaced.

    Persons are known by a title, by a given name of ``GIVEN``, or as two capitalised words of which the first
    stands as a given name, or the second as a surname (not where a sentence begins), beside a title or listed name
    anywhere in the corpus; a lone name counts where a person of the same text bears it. A name's gender is the one that most of its
    mentions show, its script that of its first letter. Groups of three digits alone are a telephone number only after a word that says
    so. Only texts that a cheap pattern lets through are read by Python and joined; the others pass
    as they are. The same entity has the same surrogate in all documents, under one key; where a form has few
    values left, surrogates are longer.

    Null text stays null with 0 mentions, and so does an empty one. Rows that repeat are each replaced alike;
    a null id is a value like any other. An empty table gives no rows. A column ``n_entities`` is replaced;
    others pass through, whatever their names.
    """
    inner, name = sheltered(docs, ADDED)
    text, id_ = name[text_col], name[id_col]
    maybe = F.coalesce(F.col(text).rlike(MAYBE), F.lit(False))
    some, none = inner.where(maybe), inner.where(~maybe).withColumn("n_entities", F.lit(0))
    keyed = some.withColumns({"ra": F.xxhash64(F.col(id_), F.col(text)), "rb": F.xxhash64(F.lit(9), F.col(text))})
    sexless = lambda c: F.when(F.col(c).contains(":"), F.regexp_replace(c, ":[fm]?$", "")).otherwise(F.col(c))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for ra, rb, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows |= {(ra, rb, k, n) for _, _, k, n in mentions(t)} | {(ra, rb, f"pair {scripts}", n) for _, _, n, scripts in pairs(t)}
            cols = list(zip(*sorted(rows))) or [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["ra", "rb", "kind", "norm"])

    found_ = cut(keyed.select("ra", "rb", text).mapInArrow(find, "ra bigint, rb bigint, kind string, norm string"))
    sure = found_.where("kind NOT LIKE 'pair %'")
    bearers = lambda kind, c: sure.where(F.col("kind").startswith(kind)).select(F.col("norm").alias(c)).distinct()
    scripts = F.split("kind", " ")
    two = found_.where("kind LIKE 'pair %'").select("ra", "rb", "norm", scripts[1].alias("s1"), scripts[2].alias("s2"), F.regexp_replace(F.element_at(F.split("norm", " "), 1), r"^\^", "").alias("first"), F.element_at(F.split("norm", " "), 2).alias("last"))
    persons = cut(two.join(bearers("given", "first"), "first", "left_semi").unionByName(two.where(~F.col("norm").startswith("^")).join(bearers("surname", "last"), "last", "left_semi")).distinct())
    new_names = F.explode(F.array(*[F.struct(F.concat_ws(":", F.lit(k), F.col(s), F.lit("")).alias("kind"), F.col(c).alias("norm")) for k, c, s in (("given", "first", "s1"), ("surname", "last", "s2"))]))
    each = sure.unionByName(persons.select("ra", "rb", new_names.alias("x")).select("ra", "rb", "x.kind", "x.norm"))
    each = cut(each.select("ra", "rb", sexless("kind").alias("kind"), "norm", F.when(F.col("kind").endswith(":f"), "f").when(F.col("kind").endswith(":m"), "m").alias("sex")).distinct())
    shown_sex = F.when(F.count_if(F.col("sex") == "f") + F.count_if(F.col("sex") == "m") == 0, "").when(F.count_if(F.col("sex") == "f") >= F.count_if(F.col("sex") == "m"), "f").otherwise("m")
    entities = each.groupBy("kind", "norm").agg(shown_sex.alias("sex"))
    entities = entities.select(F.when(F.col("kind").contains(":"), F.concat_ws(":", "kind", "sex")).otherwise(F.col("kind")).alias("kind"), "norm")
    names = assigned(entities, key).select(sexless("kind").alias("kind"), "norm", "new")
    rows = each.select("ra", "rb", "kind", "norm").distinct().join(names, ["kind", "norm"])
    marks = persons.select("ra", "rb", F.lit("pair").alias("kind"), "norm", F.lit("").alias("new"))
    lists = cut(rows.select(*marks.columns).unionByName(marks).groupBy("ra", "rb").agg(F.collect_list(F.struct("kind", "norm", "new")).alias("map")))
    joined = keyed.join(lists, ["ra", "rb"], "left").select(*inner.columns, "map")
    at = inner.columns.index(text)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for t, listed in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                new = {(p["kind"], p["norm"]): p["new"] for p in listed or ()}
                out, last, n = [], 0, 0
                for start, end, kind, norm in mentions(t, {x for k, x in new if k == "pair"}) if new else ():
                    out += [t[last:start], shown(kind, t[start:end], new[base(kind), norm])]
                    last, n = end, n + 1
                texts.append("".join([*out, t[last:]]))
                counts.append(n)
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int32())], names=[*b.schema.names[:-1], "n_entities"])

    schema = StructType([*inner.schema.fields, StructField("n_entities", IntegerType())])
    return restored(joined.mapInArrow(replace, schema).unionByName(none), docs, ADDED)
