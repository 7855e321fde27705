"""PII (4): keyed surrogates of the same type and format.

Detected entities are e-mail addresses, IPv4 and IPv6 addresses, card and account
numbers, phone numbers, social security numbers, IBANs, and person names
after a form of address or a name field (all their words, particles such as
"de la" between them left as they are; with later mentions of the same name).  A surrogate follows from the key and the entity alone, so equal
entities get equal surrogates in every document and spelling (coreference):

* numbers: a keyed Feistel permutation of the digits (distinct by
  construction); separators, country code, leading digit and the validity of
  the check digit stay;
* addresses: a keyed permutation within the address block (private, link-local
  and loopback addresses stay such, public ones stay public; IPv6 keeps its first
  16 bits), or a keyed name and domain (e-mail, one surrogate domain per domain);
* names: keyed syllables in the script of the name, with an ending for its
  gender and its capitals; family and given names are mapped on their own,
  so that short and long forms of a name agree.

Distinctness is checked over the whole corpus: entities whose surrogates are
equal, or are themselves entities of the corpus, are keyed again with the
next attempt until none is left.  A name is one entity whatever the gender of its
mentions: they share the attempt, and differ in the ending at most.  The table of entities is shuffled by
surrogate, so no group grows; documents then take the attempts above 0 of
their own entities by a join.  Texts are otherwise rewritten where they are.

Defined cases: null text stays null; rows with equal or null ids share the
attempts of the id; repeated rows are rewritten one by one; other columns
stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coverlake.llm.common import free_name, read, small_batches, stored

KEY = b"change this key"

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
IP = re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)(?!\w)")
IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{2,39}(?![\w:])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
CARD = re.compile(r"(?<![\w+])\d(?:[ -]?\d){12,18}(?!\w)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
DATE = re.compile(r"\d{4}[-./]\d{2}[-./]\d{2}|\d{2}[-./]\d{2}[-./]\d{4}")
# a date (left alone); + and 7 to 15 digits; an area code and a long group; a trunk 0 and digits; short groups
PHONE = re.compile(
    rf"(?<![\w+])(?:(?:{DATE.pattern})(?![./-]?\d)|\+\d(?:[ ./()-]{{0,2}}\d){{6,14}}"
    r"|(?:\(\d{1,5}\)[ ./-]?|0\d{1,4}[ ./-]|\d{3}[ /-](?=\d{7}(?!\d)))\d{6,9}(?:-\d{1,4})?|0\d{8,11}"
    r"|(?:\(\d{1,5}\)[ ./-]?)?\d{2,5}(?:[ ./-]\d{2,5}){0,4})(?!\w)")
# Country codes of one and two digits; all others have three.
COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
DIGIT = re.compile(r"[0-9]")

# Forms of address and their gender.
ADDRESS = {
    "m": "Mr Mister Sir Herr Herrn Monsieur Señor Sr Signor г-н Господин",
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Mademoiselle Señora Señorita Sra Srta Signora г-жа Госпожа",
    "n": "Dr Prof Professor Doctor Name Nombre Nom Имя",
}
GENDER = {word: g for g, words in ADDRESS.items() for word in words.split()}
_FIELD = {"Name", "Nombre", "Nom", "Имя"}
_TOKEN = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
TITLE = re.compile(rf"\b({'|'.join(sorted(GENDER, key=len, reverse=True))})(\.?:?)[ \t]+(?={_TOKEN})")
WORD = re.compile(_TOKEN)
NEXT = re.compile(rf"[ \t]+(?={_TOKEN})")
# Small words inside a name.
PARTICLES = set("de del della der den des di do dos du da das la las le los van von zu zum zur ten ter af av y e bin ibn al el".split())

SYLLABLES = {
    "latin": ("ba be bi bo bu da de di do du fa fe fi fo ga ge gi go ka ke ki ko la le li lo lu ma me mi mo mu na ne ni no nu "
              "pa pe pi po ra re ri ro ru sa se si so su ta te ti to tu va ve vi vo").split(),
    "cyrillic": "ба ве га да же за ка ла ма на па ра са та фа ди ги ки ли ми ни ри си ти бо во го до ко ло мо но по ро со то лу му ну ру".split(),
    "greek": "βα γα δα κα λα μα να πα ρα σα τα δι γι κι λι μι νι ρι σι τι βο γο κο λο μο νο πο ρο σο το".split(),
}
GIVEN_END = {"latin": {"m": "n", "f": "na", "n": "l"}, "cyrillic": {"m": "н", "f": "на", "n": "ль"}, "greek": {"m": "ς", "f": "να", "n": "λ"}}
FAMILY_END = {"latin": {"m": "r", "f": "r", "n": "r"}, "cyrillic": {"m": "в", "f": "ва", "n": "к"}, "greek": {"m": "ς", "f": "υ", "n": "ς"}}

BLOCKS = [ipaddress.IPv4Network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")]
"""Address blocks that an address does not leave."""

ENTITY = "struct<kind:string,start:int,end:int,value:string,entity:string>"


def number(key: bytes, *parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode(), key=key[:64], digest_size=16).digest(), "big")


def permute(digits: str, key: bytes, tweak: str) -> str:
    """A keyed permutation of the digit strings of this length (Feistel, 10 rounds)."""
    if len(digits) < 2:
        return str((int(digits or "0") + number(key, tweak, "1")) % 10) if digits else ""
    cut = len(digits) // 2
    a, b = digits[:cut], digits[cut:]
    for k in range(10):
        step = number(key, tweak, str(len(digits)), str(k), b)
        a, b = b, str((int(a) + step) % 10 ** len(a)).zfill(len(a))
    return a + b


def permute_bits(value: int, bits: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of the numbers of so many bits (Feistel, 10 rounds)."""
    wide, narrow = bits - bits // 2, bits // 2
    a, b = value >> narrow, value & ((1 << narrow) - 1)        # a has ``wide`` bits; the widths change places in each round
    for k in range(10):
        a, b = b, (a + number(key, tweak, str(bits), str(k), str(b))) & ((1 << wide) - 1)
        wide, narrow = narrow, wide
    return a << narrow | b


def iban_rest(iban: str) -> int:
    """The remainder of the check; 1 for a valid number."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def luhn(digits: str) -> int:
    """Sum of the check; 0 modulo 10 for a valid number."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10


def script(word: str) -> str:
    for c in word:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
    return "latin"


def name_of(seed: int, syllables: list[str], n: int) -> str:
    out = ""
    for _ in range(n):
        seed, k = divmod(seed, len(syllables))
        out += syllables[k]
    return out


def surrogate(kind: str, entity: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The canonical surrogate of a canonical entity."""
    tweak = f"{kind} {attempt}"
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        shown = name_of(number(key, tweak, "local", local, domain), SYLLABLES["latin"], 6)
        host = name_of(number(key, "domain", domain), SYLLABLES["latin"], 5)
        mark = re.sub(r"[a-z]+", "", local)[:1]
        return f"{shown}{mark if mark in '._-+' else ''}{number(key, tweak, 'mark', entity) % 90 + 10}@{host}.example"
    if kind == "ip":
        address = int(ipaddress.IPv4Address(entity))
        block = next((n for n in BLOCKS if ipaddress.IPv4Address(entity) in n), None)
        if block is not None:
            return str(block.network_address + permute_bits(address & int(block.hostmask), 32 - block.prefixlen, key, tweak))
        while True:                                   # a public address: walk on until the permutation gives one
            address = permute_bits(address, 32, key, tweak)
            if not any(ipaddress.IPv4Address(address) in n for n in BLOCKS):
                return str(ipaddress.IPv4Address(address))
    if kind == "ipv6":
        address = int(ipaddress.IPv6Address(entity))
        low = permute_bits(address & ((1 << 112) - 1), 112, key, tweak)
        return str(ipaddress.IPv6Address(address >> 112 << 112 | low))
    if kind == "card":
        if luhn(entity) == 0:
            body = entity[0] + permute(entity[1:-1], key, tweak + " valid")
            return next(body + c for c in "0123456789" if luhn(body + c) == 0)
        out = entity
        while True:                                   # stays among the numbers that fail the check
            out = out[0] + permute(out[1:], key, tweak)
            if luhn(out):
                return out
    if kind == "phone":
        plus = entity[:entity.index(" ") + 1] if " " in entity else entity[:entity[0] == "0"]     # country code and a blank, or trunk 0
        return plus + permute(entity[len(plus):], key, tweak)
    if kind == "ssn":
        return permute(entity, key, tweak)
    if kind == "iban":
        letters = iter(number(key, tweak, entity).to_bytes(16, "big") * 3)
        digits = iter(permute("".join(c for c in entity[4:] if c.isdigit()), key, tweak))
        body = "".join(next(digits) if c.isdigit() else chr(65 + next(letters) % 26) for c in entity[4:])
        right = 98 - iban_rest(f"{entity[:2]}00{body}")
        if iban_rest(entity) == 1:                    # a valid number stays valid, any other one invalid
            return f"{entity[:2]}{right:02d}{body}"
        wrong = number(key, tweak, "check", entity) % 97
        return f"{entity[:2]}{wrong + (wrong >= right):02d}{body}"
    part, gender = kind.split("_")
    letters = script(entity)
    end = (GIVEN_END if part == "given" else FAMILY_END)[letters][gender]
    return name_of(number(key, part, str(attempt), entity), SYLLABLES[letters], 3 + min(attempt, 20)) + end


def canonical(kind: str, value: str) -> str:
    """What all spellings of an entity have in common."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(value))
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        if value[0] != "+":
            return digits
        shown = re.match(r"\+(\d{1,3})(?=\D)", value)
        code = shown[1] if shown else COUNTRY.match(digits)[0]
        return f"+{code} {digits[len(code):]}"
    return value.casefold()


def rendered(kind: str, value: str, new: str) -> str:
    """The surrogate in the format of the mention: separators, blanks, capitals."""
    if kind in ("card", "ssn", "phone", "iban"):
        left = iter(re.sub(r"[^0-9A-Z]", "", new) if kind == "iban" else re.sub(r"\D", "", new))
        return "".join(next(left) if c.isdigit() or kind == "iban" and c != " " else c for c in value)
    if kind in ("email", "ip", "ipv6"):
        return new
    if value.isupper() and len(value) > 1:
        return new.upper()
    return new[0].upper() + new[1:] if value[0].isupper() else new


def is_ipv6(text: str) -> bool:
    try:
        return bool(int(ipaddress.IPv6Address(text)) >> 16)          # not ::, ::1 and the like
    except ValueError:
        return False


def name_words(text: str, at: int) -> list[str]:
    """The capitalised words of the name that begins at ``at``, to its end."""
    words = []
    while True:
        w = WORD.match(text, at)
        if not w or w[0] in GENDER:
            return words
        if w[0][0].isupper():
            words.append(w[0])
        elif not words or w[0] not in PARTICLES:
            return words
        gap = NEXT.match(text, w.end())
        if not gap:
            return words
        at = gap.end()


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities of a text, in order, none overlapping."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *m.span()) for m in EMAIL.finditer(text)]
    if ":" in text:
        found += [("ipv6", *m.span()) for m in IPV6.finditer(text) if is_ipv6(m[0])]
    if DIGIT.search(text):
        for kind, pattern in (("ip", IP), ("iban", IBAN), ("ssn", SSN), ("card", CARD), ("phone", PHONE)):
            more = []
            at, known = 0, sorted(found, key=lambda s: s[1])
            for m in pattern.finditer(text):
                a, b = m.span()
                while at < len(known) and known[at][2] <= a:
                    at += 1
                if kind == "phone":
                    if at < len(known) and a < known[at][1] < b:        # ends where the next entity begins
                        m = pattern.match(text, a, known[at][1])
                        if not m:
                            continue
                        b = m.end()
                    n = sum(c.isdigit() for c in m[0])
                    if not 7 <= n <= 15 or DATE.fullmatch(m[0]) or not (m[0][0] in "+(0" or re.search(r"\d[ ./-]\d", m[0])):
                        continue
                if at < len(known) and known[at][1] < b:
                    continue
                more.append((kind, a, b))
            found += more
    people: dict[str, str] = {}
    for m in TITLE.finditer(text):
        if (m[1] in _FIELD) != (":" in m[2]):
            continue
        words = name_words(text, m.end())
        for k, w in enumerate(words):
            if len(w) > 1:
                people.setdefault(w.casefold(), f"{'family' if k == len(words) - 1 else 'given'}_{GENDER[m[1]]}")
    if people:
        known = sorted(found, key=lambda s: s[1])
        at = 0
        for w in re.finditer(_TOKEN, text):
            kind = people.get(w[0].casefold()) if w[0][0].isupper() else None
            if kind:
                while at < len(known) and known[at][2] <= w.start():
                    at += 1
                if at == len(known) or known[at][1] >= w.end():
                    found.append((kind, *w.span()))
    return sorted(found, key=lambda s: s[1])


def replace(text: str | None, attempts: dict[tuple[str, str], int], key: bytes = KEY) -> str | None:
    """The text with every entity replaced; ``attempts`` holds those above 0."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in detect(text):
        entity = canonical(kind, text[a:b])
        out += [text[at:a], rendered(kind, text[a:b], surrogate(kind, entity, attempts.get((kind, entity), 0), key))]
        at = b
    return "".join(out) + text[at:]


def find_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind, start, end, value, entity: one row per mention."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                out += [(doc_id, k, a, b, text[a:b], canonical(k, text[a:b])) for k, a, b in detect(text)]
            if out:
                kinds = pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "kind", "start", "end", "value", "entity"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, kind string, start int, end int, value string, entity string")


def distinct_attempts(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, entity, attempt, surrogate of distinct entities (kind, entity):
    no two surrogates of a group of kinds are equal, and none is an entity."""

    @F.pandas_udf("string")
    def keyed(kind: pd.Series, entity: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, e, a, key) for k, e, a in zip(kind, entity, attempt)], dtype=object)

    # the same name may be met with several genders: they are kinds of their own that share one space of surrogates
    space = F.split("kind", "_")[0]
    table = entities.select("kind", "entity").distinct().withColumn("space", space).withColumn("attempt", F.lit(0))
    table = stored(table.withColumn("surrogate", keyed("kind", "entity", "attempt")), "surrogates")
    real = table.select("space", F.col("entity").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    while True:
        # the first holder of a surrogate keeps it, unless it is an entity itself; all kinds of an entity go on together
        rank = F.dense_rank().over(W.partitionBy("space", "surrogate").orderBy("attempt", "entity"))
        ranked = table.withColumn("rank", rank).join(real, ["space", "surrogate"], "left")
        taken = (F.col("rank") > 1) | F.coalesce("real", F.lit(False))
        ranked = ranked.withColumn("again", F.max(taken).over(W.partitionBy("space", "entity")))
        ranked = stored(ranked.select("kind", "entity", "space", F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"),
                                      "surrogate", "again"), "ranked-surrogates")
        if ranked.filter("again").isEmpty():
            return ranked.select("kind", "entity", "attempt", "surrogate")
        fresh = F.when(F.col("again"), keyed("kind", "entity", "attempt")).otherwise(F.col("surrogate"))
        table = stored(ranked.select("kind", "entity", "space", "attempt", fresh.alias("surrogate")), "surrogates")


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced."""
    found = stored(find_entities(docs, id_col, text_col), "entities")
    again = stored(distinct_attempts(found, key).filter("attempt > 0").select("kind", "entity", "attempt"), "attempts")
    own = stored(found.join(again, ["kind", "entity"]).groupBy("doc_id").agg(
        F.collect_set(F.struct("kind", "entity", "attempt")).alias("attempts")), "doc-attempts")
    names = free_name(docs, "pii_id"), free_name(docs, "pii_attempts")
    own = own.select(F.col("doc_id").alias(names[0]), F.col("attempts").alias(names[1]))

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series, attempts: pd.Series) -> pd.Series:
        return pd.Series([replace(t, {(x["kind"], x["entity"]): x["attempt"] for x in (a if a is not None else ())}, key)
                          for t, a in zip(texts, attempts)], dtype=object)

    joined = docs.join(own, F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col(names[0])), "left")
    text = rewrite(F.col(f"`{text_col}`").cast("string"), F.col(names[1]))
    return joined.select(*[(text if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def q_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates."""
    return replace_entities(read(spark, sf_dir, "documents").select("doc_id", "text"))
