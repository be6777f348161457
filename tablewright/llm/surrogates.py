"""Operator 5: personal data replaced by surrogates.

Entities are found by patterns.  Each has a *canonical* form that its spellings
share (an address in small letters, the digits of a number); the canonical form
gets a surrogate of the same kind from a keyed hash, and every mention is
rewritten with the surrogate in the mention's own format (case, separators,
country code).  So equal entities stay equal and different ones different, in
all documents.  The key is the caller's; there is no default.

Kinds: e-mail address (top level kept), telephone number (separated, with country
code or of ten digits; country code kept, area and exchange begin with 2-9), IPv4
address (valid octets), payment card (first digit kept, a valid check digit stays
valid and a wrong one wrong), social security number, access key (prefix kept),
secret after ``password=``, ``Token: "`` and the like, 40-digit hexadecimal token,
given names of a list, capitalised or in capitals, which get a name of the same
gender and script, and other names (``surname``) by context: after a title, after a
greeting, or after a listed given name.  Those get vowels for vowels and consonants
for consonants of their script, so they can be spoken.  A listed given name that is a
part of an e-mail address's local part becomes there what it becomes in the text.
What is not found is listed in the README.

Collisions: a surrogate must differ from the other surrogates of its kind and
from every canonical form in the data; where it does not, the entity with the
smallest canonical form keeps it and the others draw again.  Each list of names is
put into a keyed order and each name becomes the next one there: no name stays, no
two become one, so no check is needed, and a known pair tells no other pair.  A
format that is used up grows: letters
of other scripts become letters at once, in secrets punctuation does from the third
draw on, and keyed digits (surnames: letters) are added, one more for each further draw.

Native: DataFrame operations only.  Only documents with entities, and the table
of distinct entities, are shuffled; an entity in very many documents is one row
of that table, and the join on it splits hot keys.

Defined results: null text gives null, the empty text itself; texts without
entities are returned unchanged; repeated rows are rewritten alike; an empty
table gives no rows; other columns are ignored.  Texts are read whole.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import stage

# Common given names by script and gender.
NAMES = {
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Emma Olivia Sophia Isabella Charlotte Julia Laura Marie Camille".split(),
    ("latin", "m"): "James Robert John Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Peter Oliver Lucas Hugo Pierre Stefan Carlos".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Екатерина Татьяна Ирина".split(),
    ("cyrillic", "m"): "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай".split(),
}
# Vowels and consonants by script, as far as they are common in names.
SOUNDS = {"latin": ("aeiou", "bcdfghjklmnpqrstvwxyz"), "cyrillic": ("аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь")}
_LISTED = [n for names in NAMES.values() for n in names]
_GIVEN = "|".join([*_LISTED, *(n.upper() for n in _LISTED)])
_SECRET_BEFORE = r"(?i:\b(?:password|passwd|secret|token)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?)"
#: Separated groups of 3-3-4 digits; a country code and seven digits or more; ten or eleven digits without separators.
_PHONE = (r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
          r"|\+[1-9](?:[ .-]?\(?\d\)?){7,14}|1?[2-9]\d{2}[2-9]\d{6}")
_COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
_TITLES = r"Mr|Mrs|Ms|Dr|Prof|Miss|Herr|Frau|MR|MRS|MS|DR|PROF"
_GREETINGS = "Dear|Hi|Hello|Hey"
#: Capitalised words after a greeting or a given name that are no names.
_NO_NAMES = ("Sir|Sirs|Madam|All|Team|World|There|Everyone|Everybody|Friend|Friends|Reader|Readers|Customer|Customers|Colleague|Colleagues|"
             "The|This|That|These|Those|And|Or|But|Of|In|On|At|To|For|From|By|With|As|If|It|Is|Was|He|She|They|We|You|His|Her|My|Our|Mr|Mrs|Ms|Dr|Prof|Miss")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kind and pattern, in the order in which they are tried.  Each begins with a
#: test of one character, as most places of a text begin no entity.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}",
    "access_key": r"(?=A)\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    # A single word without quotes after a colon and a blank is prose.
    "secret": rf"(?<=[=:\s\"'])(?<=[=:][ \t]{{0,4}}[\"']?)(?<={_SECRET_BEFORE})(?!(?<=:[ \t]{{1,4}})\p{{L}}\p{{Ll}}++[.!?)]*+(?:[\s\"'&,;]|$))[^\s\"'&,;]{{6,}}",
    "hex_token": r"(?=[0-9a-fA-F])\b[0-9a-fA-F]{40}\b",
    "phone": rf"(?=[+(\d])(?<![\w+])(?:{_PHONE})(?!\w)",
    "ssn": r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?=[3-6])(?<![\w.-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{3,4}(?![\w-])",
    "ipv4": rf"(?=\d)(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "name": rf"(?=[A-ZА-Я])(?<![\p{{L}}\p{{N}}_])(?:{_GIVEN})(?![\p{{L}}\p{{N}}_])",
    # After a greeting, a word that goes on in small letters is none ("Dear Python users").
    "surname": rf"(?=\p{{Lu}})(?<= )(?!(?<=(?<![\p{{L}}\p{{N}}_])(?:{_GREETINGS}) )\p{{Lu}}[\p{{L}}'’]+ \p{{Ll}})(?<=(?<![\p{{L}}\p{{N}}_])(?:(?:{_TITLES})\.?|{_GREETINGS}|{_GIVEN}) )(?!(?i:{_NO_NAMES})(?![\p{{L}}\p{{N}}_]))"
               r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)*(?![\p{L}\p{N}_])",
}
#: No entity begins after a letter or digit or with a blank, so one test passes over the places inside words.
ANY = r"(?=\S)(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
_MAX_DRAWS = 64
_BEFORE = 24  # characters of the text before a mention that tell a secret from a name


def _kind(mention: Column, before: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        test = {"email": mention.contains("@") & mention.rlike(f"^(?:{PATTERNS['email']})$"), "access_key": mention.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$"),
                "hex_token": mention.rlike(r"^[0-9a-fA-F]{40}$"), "phone": mention.rlike(f"^(?:{_PHONE})$"),
                "ssn": mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "card": mention.rlike(r"^[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{3,4}$"),
                "ipv4": mention.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")}.get(kind)
        if test is not None:
            out = F.when(test, kind).otherwise(out)
    listed = mention.isin([*_LISTED, *(n.upper() for n in _LISTED)])
    return F.when((out == "name") & ~listed, F.when(before.rlike(f"{_SECRET_BEFORE}$"), "secret").otherwise("surname")).otherwise(out)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _canonical(kind: Column, mention: Column) -> Column:
    abroad = (kind == "phone") & mention.startswith("+") & ~_digits(mention).startswith("1")
    return (F.when(abroad, F.concat(F.lit("+"), _digits(mention)))
            .when(kind.isin("email", "hex_token"), F.lower(mention)).when(kind == "phone", F.right(_digits(mention), F.lit(10)))
            .when(kind.isin("name", "surname"), F.concat(F.left(mention, F.lit(1)), F.lower(F.substring(mention, F.lit(2), F.length(mention)))))
            .when(kind.isin("ssn", "card"), _digits(mention)).otherwise(mention))


def _stream(key: str, n: Column) -> Column:
    """Two hexadecimal digits for each of ``n`` characters."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / 64).cast("int")),
                         lambda b: F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "canonical", F.col("draw").cast("string"), b.cast("string")).cast("binary"), 512))
    return F.array_join(blocks, "")


def _number(i: Column) -> Column:
    return F.conv(F.substring(F.col("__stream"), i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _by_class(c: Column, i: Column) -> Column:
    """A character of the same class: digit, small or capital letter of its script."""
    n, code = _number(i), F.ascii(c)
    return (F.when(c.between("0", "9"), F.chr(48 + n % 10)).when(c.between("a", "z"), F.chr(97 + n % 26))
            .when(c.between("A", "Z"), F.chr(65 + n % 26)).when((code >= 0x430) & (code <= 0x44F), F.substring(F.lit("абвгдежзийклмнопрстуфхцчшщъыьэюя"), n % 32 + 1, F.lit(1)))
            .otherwise(c))


def _other_class(c: Column, i: Column) -> Column:
    """As ``_by_class``, but no letter stays: those of other scripts become letters,
    and from the third draw on other characters too."""
    n, small = _number(i), "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    letter = c.rlike(r"[\p{L}\p{N}\p{M}]") | (F.col("draw") >= 2)
    return (F.when(c.between("А", "Я"), F.substring(F.lit(small.upper()), n % 32 + 1, F.lit(1)))
            .when(c.rlike("[0-9a-zA-Zа-я]"), _by_class(c, i)).when(letter & c.rlike(r"\p{Lu}"), F.chr(65 + n % 26))
            .when(letter, F.chr(97 + n % 26)).otherwise(c))


def _by_sound(c: Column, i: Column) -> Column:
    """A vowel for a vowel and a consonant for a consonant, small or capital, of the
    same script; other scripts give Latin letters, other characters stay."""
    n, out, low = _number(i), F.when(c.rlike(r"[^\p{L}\p{N}\p{M}]"), c), F.lower(c)
    for letters in (*SOUNDS["cyrillic"], *SOUNDS["latin"]):
        drawn = F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
        out = out.when(F.lit(letters).contains(low), F.when(c == low, drawn).otherwise(F.upper(drawn)))
    return out.otherwise(_other_class(c, i))


def _added(key: str) -> Column:
    """Keyed digits, one more for each failed draw: a format that is used up grows.
    Kinds of a fixed length get them later and after an ``x``; surnames get letters."""
    free = F.col("kind").isin("secret", "surname", "email")
    digits = F.translate(F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("added"), "kind", "canonical", F.col("draw").cast("string")).cast("binary"), 256), "abcdef", "012345")
    n = F.greatest(F.col("draw") - F.when(free, 2).otherwise(7), F.lit(0))
    more = F.substring(digits, F.lit(1), n)
    spoken = F.when(F.col("canonical").rlike("[А-Яа-я]"), F.translate(more, "0123456789", "ановилерис")).otherwise(F.translate(more, "0123456789", "anovileris"))
    return F.when(n > 0, F.when(F.col("kind") == "surname", spoken).when(free, more).otherwise(F.concat(F.lit("x"), more))).otherwise("")


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    values = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 1, (c.try_cast("int") * 2) % 10 + F.floor(c.try_cast("int") * 2 / 10)).otherwise(c.try_cast("int")).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10


def name_pairs(key: str) -> dict[str, str]:
    """The surrogate of each listed name: the next one in a keyed order of its list."""
    out = {}
    for names in NAMES.values():
        order = sorted(names, key=lambda name: hmac.digest(key.encode(), f"name {name}".encode(), hashlib.sha256))
        out.update(zip(order, order[1:] + order[:1], strict=True))
    return out


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _local_part(key: str, local: Column, drawn: Column) -> Column:
    """The drawn local part of an address with its listed names as in the text.
    Drawn characters keep their class, so both sides split at the same places."""
    pairs = _lookup({a.lower(): b.lower() for a, b in name_pairs(key).items()})
    edge = r"(?=[._%+-])|(?<=[._%+-])"
    return F.array_join(F.zip_with(F.split(local, edge), F.split(drawn, edge), lambda a, b: F.coalesce(F.try_element_at(pairs, a), b)), "")


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Add ``surrogate`` to (kind, canonical, draw)."""
    c, kind = F.col("canonical"), F.col("kind")
    any_class = F.array_join(F.transform(_chars(c), _other_class), "")
    tail = F.length(F.substring_index(c, ".", -1)) + 1
    address = F.array_join(F.transform(_chars(F.left(c, F.length(c) - tail)), _by_class), "")
    added = _added(key)
    local = _local_part(key, F.substring_index(c, "@", 1), F.substring_index(address, "@", 1))
    spoken = F.array_join(F.transform(_chars(c), _by_sound), "")
    email = F.concat(local, added, F.lit("@"), F.substring_index(address, "@", -1), F.right(c, tail))
    code = F.length(F.regexp_extract(c, rf"^\+(?:{_COUNTRY})", 0))
    abroad = F.array_join(F.transform(_chars(c), lambda x, i: F.when(i < code, x).when((i == code) & (x != "0"), F.chr(49 + _number(i) % 9)).otherwise(_by_class(x, i))), "")
    phone = F.array_join(F.transform(_chars(c), lambda x, i: F.when(i.isin(0, 3), F.chr(50 + _number(i) % 8)).otherwise(_by_class(x, i))), "")
    ssn = F.array_join(F.transform(_chars(c), lambda x, i: F.when(i == 0, F.chr(49 + _number(i) % 8)).otherwise(_by_class(x, i))), "")
    ipv4 = F.array_join(F.transform(F.split(c, r"\."), lambda x, i: (1 + _number(i) % 254).cast("string")), ".")
    hexa = F.array_join(F.transform(_chars(c), lambda x, i: F.substring(F.col("__stream"), i * 2 + 1, F.lit(1))), "")
    middle = F.array_join(F.transform(_chars(F.left(c, F.length(c) - 1)), lambda x, i: F.when(i == 0, x).otherwise(_by_class(x, i))), "")
    check = F.pmod(_luhn(c) - _luhn(F.concat(middle, F.lit("0"))), F.lit(10)).cast("string")
    access = F.concat(F.left(c, F.lit(4)), F.array_join(F.transform(_chars(F.substring(c, 5, 64)), _by_class), ""))
    return (entities.withColumn("__stream", _stream(key, F.length(c)))
            .withColumn("surrogate", F.when(kind == "email", email).when((kind == "phone") & c.startswith("+"), abroad).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "ipv4", ipv4)
                        .when(kind == "card", F.concat(middle, check)).when(kind == "access_key", access)
                        .when((kind == "hex_token") | ((kind == "secret") & c.rlike("^[0-9a-f]+$")), hexa).when(kind == "name", F.try_element_at(_lookup(name_pairs(key)), c))
                        .when(kind == "surname", spoken).otherwise(any_class))
            .withColumn("surrogate", F.when(kind.isin("email", "name"), F.col("surrogate")).otherwise(F.concat("surrogate", added)))
            .drop("__stream"))


def assign(entities: DataFrame, key: str, draw=draw_surrogates) -> DataFrame:
    """(kind, canonical, surrogate) for distinct (kind, canonical), free of collisions."""
    originals = entities.select("kind", F.col("canonical").alias("surrogate"))
    pending, accepted = entities, None
    for turn in range(_MAX_DRAWS):
        drawn = draw(pending.withColumn("draw", F.lit(turn)), key).drop("draw")
        winners = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        names = winners.where("kind = 'name'")
        taken = originals if accepted is None else originals.union(accepted.select("kind", "surrogate"))
        free = names.unionByName(winners.where("kind <> 'name'").join(taken, ["kind", "surrogate"], "left_anti")).select("kind", "canonical", "surrogate")
        free = stage(free, "surrogates")
        accepted = free if accepted is None else accepted.union(free)
        pending = stage(pending.join(free.select("kind", "canonical"), ["kind", "canonical"], "left_anti"), "surrogates-pending")
        if pending.isEmpty():
            return accepted
    raise ValueError(f"no free surrogates after {_MAX_DRAWS} draws: too many entities for their format")


def _render(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention."""
    # The digits of the surrogate go to the last digits of the mention, in their order; those added follow.
    number = _digits(F.substring_index(surrogate, "x", 1))
    skip = F.length(_digits(mention)) - F.length(number)
    filled = F.aggregate(
        _chars(mention), F.struct(F.lit("").alias("text"), F.lit(0).alias("seen")),
        lambda a, c: F.when(c.between("0", "9"), F.struct(
            F.concat(a["text"], F.when(a["seen"] < skip, c).otherwise(F.substring(number, a["seen"] - skip + 1, F.lit(1)))).alias("text"),
            (a["seen"] + 1).alias("seen"))).otherwise(F.struct(F.concat(a["text"], c).alias("text"), a["seen"].alias("seen"))),
        lambda a: F.concat(a["text"], F.regexp_extract(surrogate, "x.*$", 0)))
    cased = F.array_join(F.zip_with(_chars(mention), _chars(surrogate), lambda m, s: F.when(m.between("A", "Z"), F.upper(s)).otherwise(s)), "")
    capitals = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    return (F.when(kind.isin("phone", "ssn", "card"), filled).when(kind.isin("hex_token", "name", "surname") & capitals, F.upper(surrogate))
            .when((kind == "email") & capitals, F.upper(surrogate)).when((kind == "email") & (F.length(mention) != F.length(surrogate)), surrogate)
            .when(kind.isin("email", "hex_token", "surname"), cased).otherwise(surrogate))


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text with surrogates, n_entities and
    kinds (the kind of each mention, in their order)."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"),
                        F.coalesce(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)), F.array().cast("array<string>")).alias("mentions"))
    clean = found.where(F.size("mentions") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    hit = stage(found.where(F.size("mentions") > 0).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "mentions",
                                                          F.split(F.col("text"), ANY, -1).alias("pieces")), "pii-documents")
    found = F.zip_with("mentions", F.slice("pieces", F.lit(1), F.size("mentions")), lambda m, p: F.struct(m.alias("mention"), F.right(p, F.lit(_BEFORE)).alias("before")))
    mentions = hit.select("rid", F.posexplode(found).alias("pos", "m")).select("rid", "pos", "m.*")
    mentions = mentions.withColumn("kind", _kind(F.col("mention"), F.col("before"))).drop("before")
    mentions = mentions.withColumn("canonical", _canonical(F.col("kind"), F.col("mention")))
    table = assign(stage(mentions.select("kind", "canonical").distinct(), "pii-entities"), key)
    written = (mentions.join(table, ["kind", "canonical"])
               .select("rid", F.struct("pos", _render(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new"), "kind").alias("m")))
    per_row = written.groupBy("rid").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    text_of = F.array_join(F.zip_with("pieces", F.concat(F.transform("ms", lambda m: m["new"]), F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")
    dirty = hit.join(per_row, "rid").select("doc_id", text_of.alias("text"), F.size("ms").cast("long").alias("n_entities"),
                                            F.transform("ms", lambda m: m["kind"]).alias("kinds"))
    return clean.unionByName(dirty)
