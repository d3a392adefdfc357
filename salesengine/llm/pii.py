"""PII surrogates: every detected entity gets a keyed replacement of its own kind.

Entities: e-mail addresses, IBANs, phone numbers, card numbers, social security
numbers, IP addresses, and names of any number of words after one or more
titles, with initials and particles.  The words of such a name are replaced wherever else the same text
has them capitalised, with or without a title.  A replacement

* depends on the secret key and the entity alone, so one entity has one
  surrogate in the whole corpus, however it is written (spaces, dashes, case);
  names are replaced word by word, so "Mr Smith", "Mr John Smith" and a bare
  "Smith" agree; an initial is mapped by itself, a particle ("von") stays;
* keeps format: letters give letters of the same script and kind (vowel,
  consonant, accent), digits give digits, separators, case, country code, top
  level domain, first card digit, Luhn and IBAN validity stay, octets stay octets;
* keeps gender: titles stay, and so does the last letter of a name;
* is checked for collisions: against all entities of the corpus (no surrogate
  is somebody's real number) and against all other surrogates (distinct
  entities stay distinct).  What collides tries again with the next attempt;
  from attempt ``ROOMY`` on surrogates grow by a character an attempt, so a
  small space (names of two letters) can't run out.

All of it is DataFrame functions.  Rows without an entity are never shuffled.

Defined cases: null and empty texts stay as they are; rows of equal text get
equal results; an empty table gives an empty frame; all columns are kept,
whatever their names, and ``n_chars`` follows the text where there is one.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesengine.session import reliable_checkpoint

ROOMY = 6
TITLES = "Mr|Mrs|Ms|Miss|Mister|Dr|Prof|Herr|Frau|Sr|Sra|Señor|Señora|Mme|Mlle|Monsieur|Madame|M\\.|г-н|г-жа|Господин|Госпожа|Κύριος|Κυρία"
_FIRST = "".join(sorted({t[0] for t in TITLES.split("|")}))  # looked at first, as most places fail here
_STACKED = TITLES.replace("|M\\.", "")  # "M." after another title is an initial
_DEGREES = r"h\. ?c|med|phil|rer|nat|jur|Ing"
#: Titles before a name, with what parts them from it.
STACK = rf"(?:{TITLES})\.?(?:[ \u00a0](?:{_STACKED}|{_DEGREES})(?![\p{{L}}\p{{M}}])\.?)*[ \u00a0\n]"
PARTICLES = "von|van|vom|zu|zum|zur|der|den|de|del|della|di|da|das|dos|do|du|des|la|le|las|los|ter|ten|bin|ibn|al"
_IN_WORD = r"(?:[\p{L}\p{M}]|['’](?=\p{L})(?!s(?![\p{L}\p{M}])))"  # no possessive 's
_WORD = rf"(?!(?:{_STACKED})(?![\p{{L}}\p{{M}}]))\p{{Lu}}{_IN_WORD}++(?:-\p{{Lu}}{_IN_WORD}*+)*+"
_INITIALS = r"\p{Lu}\.(?:-?\p{Lu}\.)*+"
_CHUNK = rf"(?:(?:{PARTICLES})[ \u00a0]){{0,3}}(?:(?:{_INITIALS}|\p{{Lu}}(?=[ \u00a0]\p{{Lu}}))[ \u00a0]?){{0,4}}{_WORD}"
#: A word of a name: within a name that was found, and anywhere else in a text.
NAME_WORD = r"\p{L}(?:[\p{L}\p{M}]|['’](?=\p{L}))*+"
BARE = rf"(?<![\p{{L}}\p{{M}}\p{{N}}])\p{{Lu}}{_IN_WORD}++"
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"  # a sentence may run on into the address
_LOCAL = rf"[\p{{L}}\p{{M}}\p{{N}}._%+\-&&[^{_UNSPACED}]]"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Kinds in order of precedence.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL}){_LOCAL}++|(?<![{_UNSPACED}])[{_UNSPACED}]++[{_UNSPACED}0-9._-]*+)@(?:[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{M}}\p{{N}}-]*[\p{{L}}\p{{M}}\p{{N}}])?\.)+(?:xn--[A-Za-z0-9-]++|[\p{{L}}\p{{M}}&&[^{_UNSPACED}]]{{2,}}+|[{_UNSPACED}]{{2,4}}+)(?![A-Za-z0-9])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?=(?: ?[A-Z0-9]){11})(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ ./-]?\d){6,12}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\(0\d{0,4}\)(?:[ ./-]?\d){6,9}"
             r"|(?<![.-])(?:1[ .-])?\d{3}(?<sep>[ .-])\d{3}\k<sep>\d{4}"
             r"|(?<![.-])0\d{1,4}(?:(?<part>[ .-])(?=\d(?:\k<part>?\d){6,9}(?!\d|\k<part>\d))\d{2,4}(?:\k<part>\d{2,4}){1,4}|[ /-]\d{6,8}|[ /-]\d{3}(?: \d{2,3}){2,3}))(?![\p{L}\p{N}]|-\d)",
    "card": r"(?<![\p{L}\p{N}.-])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\p{L}\p{N}]|[.-]\d)",
    "ssn": r"(?<![\p{L}\p{N}.-])\d{3}(?<blank>[ -])\d{2}\k<blank>\d{4}(?![\p{L}\p{N}]|-|[ .]\d)",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*\d)(?:{_HEX}(?::{_HEX}){{7}}|(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\p{{L}}\p{{N}}]|:|\.\d)",
    "name": rf"(?=[{_FIRST}])(?<![\p{{L}}\p{{N}}]){STACK}(?:{_CHUNK}(?:[ \u00a0]{_CHUNK})*(?:[ \u00a0]{_INITIALS})?|{_INITIALS})",
}
#: All kinds as one pattern.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without these have no entity; far cheaper to look for than ANY.
HINT = rf"[@0-9]|(?=[{_FIRST}])(?<!\p{{L}})(?:{TITLES})\.?[ \u00a0\n]\p{{L}}"
#: Letters that may stand for one another (fixed values).
CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz",
    "àáâãäåæèéêëìíîïòóôõöøùúûüœ", "çñšžčćřşğłńśź",
    "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ",
)
#: Letters of other scripts, by code points: Hebrew, Arabic, Armenian, Georgian, Devanagari, Thai, kana, Han, Hangul.
RANGES = ((0x5D0, 0x5EA), (0x628, 0x63A), (0x641, 0x64A), (0x561, 0x585), (0x10D0, 0x10F0), (0x915, 0x939), (0xE01, 0xE2E), (0x3041, 0x3093), (0x30A1, 0x30F4), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
#: A country code.
CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _chars(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, 1))).otherwise(F.expr("cast(array() as array<string>)"))


def _draw(digest: Column, at: Column, digits: int = 2) -> Column:
    """A number from the digest's hex digits, ``at`` counted from 0 and round the digest."""
    start = F.pmod(at * digits, F.lit(64)) + 1
    return F.conv(F.substring(digest, start.cast("int"), F.lit(digits)), 16, 10).cast("int")


def _shifted(ch: Column, by: Column) -> Column:
    # looked up in constant arrays: a branch for each class would make the plan many times larger
    of = F.filter(F.expr("array('" + "', '".join(CLASSES) + "')"), lambda t: t.contains(ch))
    out = F.get(F.transform(of, lambda t: F.substring(t, (F.pmod(F.position(ch, t) - 1 + by, F.length(t)) + 1).cast("int"), F.lit(1))), F.lit(0))
    point = F.ascii(ch)
    spans = F.filter(F.expr("array(" + ", ".join(f"named_struct('lo', {lo}, 'hi', {hi})" for lo, hi in RANGES) + ")"), lambda r: point.between(r["lo"], r["hi"]))
    other = F.get(F.transform(spans, lambda r: F.decode(F.unhex(F.lpad(F.hex(r["lo"] + F.pmod(point - r["lo"] + by, r["hi"] - r["lo"] + 1)), 4, "0")), "UTF-16BE")), F.lit(0))
    return F.coalesce(out, F.when(point > 0x530, other), ch)


def _shift(s: Column, digest: Column, keep=lambda i, n: F.lit(False)) -> Column:
    """Every character shifted within its class; ``keep`` tells which places stay (i from 0, n characters)."""
    n = F.length(s)
    return F.array_join(F.transform(_chars(s), lambda c, i: F.when(keep(i, n), c).otherwise(_shifted(c, _draw(digest, i)))), "")


def _no_leading_zero(new: Column, old: Column, digest: Column, at: Column) -> Column:
    """``new`` with a digit other than 0 at ``at`` (from 0) if ``old`` has one."""
    first = F.when((F.substring(new, at + 1, F.lit(1)) == "0") & (F.substring(old, at + 1, F.lit(1)) != "0"), (F.pmod(_draw(digest, F.lit(31)), F.lit(9)) + 1).cast("string"))
    return F.concat(F.substring(new, F.lit(1), at), F.coalesce(first, F.substring(new, at + 1, F.lit(1))), F.substring(new, at + 2, F.length(new)))


def _luhn(body: Column) -> Column:
    """The check digit after ``body``."""
    n = F.length(body)

    def weigh(c, i):
        d = c.cast("int")
        twice = d * 2
        return F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    total = F.aggregate(F.transform(_chars(body), weigh), F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10))


def _card(unit: Column, digest: Column) -> Column:
    body = F.substring(unit, F.lit(1), F.length(unit) - 1)
    new = _shift(body, digest, lambda i, n: i == 0)
    off = F.substring(unit, F.length(unit), F.lit(1)).cast("int") - _luhn(body)
    return F.concat(new, F.pmod(_luhn(new) + off, F.lit(10)).cast("string"))


def _iban_check(iban: Column) -> Column:
    """The check digits (2 to 98) that belong to an IBAN's country and account."""
    told = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 2), F.lit("00"))

    def step(acc, c):
        digit = c.rlike("[0-9]")
        value = F.when(digit, c.try_cast("int")).otherwise(F.ascii(c) - 55)
        return F.pmod(acc * F.when(digit, 10).otherwise(100) + value, F.lit(97))
    return 98 - F.aggregate(_chars(told), F.lit(0), step)


def _iban(unit: Column, digest: Column, extra: Column) -> Column:
    """A valid IBAN gives a valid one, one that is off stays off by as much."""
    new = F.concat(F.upper(_shift(F.lower(unit), digest, lambda i, n: i < 2)), extra)
    off = F.pmod(F.substring(unit, 3, 2).cast("int") - _iban_check(unit), F.lit(97))
    check = F.when(off == 0, _iban_check(new)).otherwise(F.pmod(_iban_check(new) + off, F.lit(97)))
    return F.concat(F.substring(new, 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substring(new, F.lit(5), F.length(new)))


def _ipv6(unit: Column, digest: Column, extra: Column) -> Column:
    def hexed(c, i):
        return F.when(c == ":", c).otherwise(F.substring(F.lit("0123456789abcdef"), F.pmod(_draw(digest, i), F.lit(16)) + 1, F.lit(1)))
    return F.concat(F.array_join(F.transform(_chars(unit), hexed), ""), extra)


def _ip(unit: Column, digest: Column) -> Column:
    def octet(o, i):
        x = _draw(digest, i, 4)
        return (F.when(F.length(o) == 1, F.pmod(x, F.lit(9)) + 1).when(F.length(o) == 2, F.pmod(x, F.lit(90)) + 10).otherwise(F.pmod(x, F.lit(156)) + 100)).cast("string")
    return F.array_join(F.transform(F.split(unit, r"\."), octet), ".")


def _email(unit: Column, digest: Column, extra: Column) -> Column:
    parts = F.split(unit, "@")
    labels = F.split(parts[1], r"\.")
    host = F.array_join(F.slice(labels, F.lit(1), F.size(labels) - 1), ".")
    reserved = F.regexp_extract(host, r"(?:^|\.)example$", 0)  # names that belong to nobody stay so
    inner = F.substring(host, F.lit(1), F.length(host) - F.length(reserved))
    return F.concat(_shift(parts[0], digest), extra, F.lit("@"), _shift(inner, F.sha2(digest, 256)), reserved, F.lit("."), F.element_at(labels, -1))


def surrogate(kind: Column, unit: Column, attempt: Column, key: str) -> Column:
    """The replacement that an attempt proposes for a normalised entity."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, unit, attempt.cast("string")), 256)
    more = F.greatest(attempt - (ROOMY - 1), F.lit(0))
    digits = F.substring(F.translate(F.reverse(digest), "abcdef", "012345"), F.lit(1), more)
    letters = F.substring(F.translate(F.reverse(digest), "0123456789abcdef", "aeiouaeioulmnrst"), F.lit(1), more)
    # the country code stays, or the leading 0, or what is before ten digits
    stays = (F.when(unit.startswith("+"), F.length(F.regexp_extract(unit, CODE, 0)))
             .otherwise(F.greatest(F.length(unit) - 10, unit.startswith("0").cast("int"))))
    phone = _no_leading_zero(_shift(unit, digest, lambda i, n: i < stays), unit, digest, stays)
    return (F.when(kind == "email", _email(unit, digest, digits))
            .when(kind == "iban", _iban(unit, digest, digits))
            .when(kind == "phone", F.concat(phone, digits))
            .when(kind == "card", F.concat(_card(unit, digest), digits))
            .when(kind == "ssn", F.concat(_no_leading_zero(_shift(unit, digest), unit, digest, F.lit(0)), digits))
            .when(kind == "ipv6", _ipv6(unit, digest, digits))
            .when(kind == "ip", F.concat(_ip(unit, digest), F.when(more > 0, F.concat(F.lit("."), digits)).otherwise("")))
            .otherwise(F.concat(_shift(unit, digest, lambda i, n: (n > 2) & (i == n - 1)), letters)))


# ------------------------------------------------------------------ detection

def kind_of(match: Column) -> Column:
    out = F.lit("name")
    for k in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(match.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(out)
    return out


def _name_body(match: Column) -> Column:
    return F.regexp_replace(match, f"^{STACK}", "")


def _stays(word: Column) -> Column:
    """Words of a name that aren't looked up: initials and particles."""
    return (F.length(word) == 1) | word.rlike(f"^(?:{PARTICLES})$")


def units(kind: Column, match: Column) -> Column:
    """What of a match is mapped: its normal form, or a name's words."""
    digits = F.regexp_replace(match, r"\D", "")
    phone = F.concat(F.when(match.startswith("+"), "+").otherwise(""), F.regexp_replace(match, r"\(0\)|\D", ""))  # (0) is only dialled at home
    words = F.filter(F.regexp_extract_all(_name_body(match), F.lit(NAME_WORD), F.lit(0)), lambda w: ~_stays(w))
    return (F.when(kind.isin("email", "ipv6"), F.array(F.lower(match))).when(kind == "phone", F.array(phone)).when(kind.isin("card", "ssn"), F.array(digits))
            .when(kind == "iban", F.array(F.regexp_replace(match, " ", ""))).when(kind == "ip", F.array(match))
            .otherwise(F.transform(words, F.lower)))


def entities(text: Column) -> Column:
    """array<struct<kind, match, units>> of a text, in order."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    return F.transform(found, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("match"), units(kind_of(m), m).alias("units")))


# ------------------------------------------------------------------ collisions

def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, unit, surrogate) for the distinct entities ``found`` (kind, unit): no surrogate is an entity, and none comes twice."""
    real = reliable_checkpoint(found.distinct())
    # few bytes but much work a row: a fixed number of partitions, which adaptive execution doesn't merge
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pending = real.withColumn("attempt", F.lit(0))
    taken: list[DataFrame] = []
    while True:
        tried = reliable_checkpoint(pending.repartition(tasks, "kind", "unit").withColumn("surrogate", surrogate(F.col("kind"), F.col("unit"), F.col("attempt"), key)))
        left = tried.alias("t")
        # of those that propose the same, the least entity has it
        first = tried.groupBy("kind", "surrogate").agg(F.min("unit").alias("unit"))
        good = left.join(first, ["kind", "surrogate", "unit"], "left_semi")
        for barred in [real.select("kind", F.col("unit").alias("surrogate")), *(t.select("kind", "surrogate") for t in taken)]:
            good = good.join(barred, ["kind", "surrogate"], "left_anti")
        good = reliable_checkpoint(good.select("kind", "unit", "surrogate"))
        taken.append(good)
        pending = reliable_checkpoint(tried.join(good, ["kind", "unit"], "left_anti").select("kind", "unit", (F.col("attempt") + 1).alias("attempt")))
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, taken)


# ------------------------------------------------------------------ replacement

def _fit_case(new: Column, old: Column) -> Column:
    return (F.when((old == F.upper(old)) & (F.length(old) > 1), F.upper(new))
            .when(F.substring(old, 1, 1) == F.upper(F.substring(old, 1, 1)), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new))))
            .otherwise(new))


def _poured(match: Column, new: Column, content: str) -> Column:
    """``match`` with its content characters replaced one by one by ``new``'s; what is left over follows."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc, ch):
        here = ch.rlike(content)
        return F.struct(F.concat(acc["out"], F.when(here, F.substring(new, acc["n"] + 1, F.lit(1))).otherwise(ch)).alias("out"), (acc["n"] + here.cast("int")).alias("n"))
    return F.aggregate(_chars(match), start, step, lambda a: F.concat(a["out"], F.substring(new, a["n"] + 1, F.length(new))))


def _initial(letter: Column, key: str) -> Column:
    """An initial's replacement: a keyed shift of its class, so that no two initials meet and none stays."""
    by = int(hashlib.sha256(f"{key}\x1finitial".encode()).hexdigest(), 16) % 10_007
    while any(by % n == 0 for n in (*map(len, CLASSES), *(hi - lo + 1 for lo, hi in RANGES))):
        by += 1
    return _fit_case(_shifted(F.lower(letter), F.lit(by)), letter)


def _named(word: Column, mapping: Column) -> Column:
    """The replacement of a word of a name, null for another word."""
    return _fit_case(mapping[F.concat_ws("\x1f", F.lit("name"), F.lower(word))], word)


def _between(text: Column, pattern: str, render) -> Column:
    """``text`` with what the pattern finds rendered, where that isn't null."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda g, w: F.concat(g, F.coalesce(render(w), w, F.lit("")))), "")


def _bare(gap: Column, mapping: Column) -> Column:
    """struct<t, n> of a text between entities: with the words of the names replaced, and how many."""
    words = F.filter(F.regexp_extract_all(gap, F.lit(BARE), F.lit(0)), lambda w: _named(w, mapping).isNotNull())
    return F.struct(_between(gap, BARE, lambda w: _named(w, mapping)).alias("t"), F.size(words).alias("n"))


def _render(entity: Column, mapping: Column, key: str) -> Column:
    kind, match = entity["kind"], entity["match"]
    new = mapping[F.concat_ws("\x1f", kind, F.get(entity["units"], F.lit(0)))]
    name = _between(_name_body(match), NAME_WORD, lambda w: F.when(F.length(w) == 1, _initial(w, key)).when(~_stays(w), _named(w, mapping)))
    title = F.regexp_extract(match, f"^{STACK}", 0)
    phone = F.replace(_poured(F.replace(match, F.lit("(0)"), F.lit("\x1e")), F.replace(new, F.lit("+"), F.lit("")), "[0-9]"), F.lit("\x1e"), F.lit("(0)"))
    return (F.when(kind.isin("email", "ipv6"), F.when(match == F.upper(match), F.upper(new)).otherwise(new)).when(kind == "ip", new)
            .when(kind == "iban", _poured(match, new, "[A-Z0-9]")).when(kind == "name", F.concat(title, name))
            .when(kind == "phone", phone).otherwise(_poured(match, new, "[0-9]")))


def pseudonymise(docs: DataFrame, key: str, count_as: str | None = None) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced; ``count_as`` names a column for how many (int)."""
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("row_key"), F.col("text").alias("t"))
    marked = reliable_checkpoint(rows.select("id", "row_key", entities(F.col("t")).alias("found")).where(F.size("found") > 0))
    each = marked.select("id", "row_key", F.explode("found").alias("e")).select("id", "row_key", "e.kind", F.explode("e.units").alias("unit")).distinct()
    table = surrogates(each.select("kind", "unit"), key)
    pair = F.struct(F.concat_ws("\x1f", "kind", "unit").alias("key"), F.col("surrogate").alias("value"))
    maps = (each.join(table, ["kind", "unit"]).groupBy("id", "row_key").agg(F.map_from_entries(F.collect_set(pair)).alias("map")))
    has = F.col("t").rlike(HINT) & F.col("t").rlike(ANY)
    dirty, rest = rows.where(has), rows.where(F.coalesce(~has, F.lit(True)))
    met = dirty.join(maps.withColumnsRenamed({"id": "id2", "row_key": "key2"}), F.col("row_key").eqNullSafe(F.col("key2")) & F.col("id").eqNullSafe(F.col("id2")), "left")  # a name of initials alone has nothing to look up
    gaps = F.split("t", ANY, -1)
    mapping = F.coalesce("map", F.expr("cast(map() as map<string, string>)"))
    found = met.select("row", mapping.alias("map"), gaps.alias("gaps"), entities(F.col("t")).alias("found"))
    named = F.exists("found", lambda e: e["kind"] == "name")
    gaps = F.transform("gaps", lambda g: F.when(named, _bare(g, F.col("map"))).otherwise(F.struct(g.alias("t"), F.lit(0).alias("n"))))
    found = found.select("row", "map", gaps.alias("gaps"), "found")
    pieces = F.zip_with("gaps", "found", lambda g, e: F.concat(g["t"], F.when(e.isNull(), F.lit("")).otherwise(_render(e, F.col("map"), key))))
    bare = F.aggregate("gaps", F.lit(0), lambda n, g: n + g["n"])
    done = found.select("row", F.array_join(pieces, "").alias("t"), (F.size("found") + bare).alias("n"))
    every = done.unionByName(rest.select("row", "t", F.lit(0).alias("n")))
    fields = {c.lower(): F.col("row")[c].alias(c) for c in columns} | {"text": F.col("t").alias(next(c for c in columns if c.lower() == "text"))}
    if "n_chars" in fields:
        kind = docs.schema[next(c for c in columns if c.lower() == "n_chars")].dataType
        fields["n_chars"] = F.when(F.col("n") > 0, F.length("t").cast(kind)).otherwise(F.col("row")["n_chars"]).alias("n_chars")
    return every.select(*fields.values(), *([F.col("n").alias(count_as)] if count_as else []))
