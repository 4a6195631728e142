"""Surrogates for personal data; DataFrame functions only.

Found are e-mail addresses, phone, card and US social-security numbers, IPv4 and IPv6 addresses, hexadecimal secrets
(with a digit), keys of the common prefixes (``KEY``), names after a title of address, and in a text with such a name the
same full or family name without a title. Names that no title introduces anywhere in their text are not found: that
takes a model of language, which column functions are not.

A mention has a type and a canonical form (case, punctuation and title aside). Every canonical form of the corpus gets
one surrogate, so mentions of one entity agree everywhere. It is an HMAC-SHA256 drawn into the form of the original:
letters of the same script, digits for digits, the same length (but for names) and separators; cards keep passing or
failing the check digit; IPv4 surrogates lie in the reserved range 240.0.0.0/4, social-security numbers in the never
issued 900s, and mail domains below ``example``. Parts that are shared stay shared: the words of names are
entities of their own, and so are mail domains, so ``Mr John Smith``, ``Dr Smith`` and ``John Smith`` agree in what they
have in common. A word that is a given name somewhere takes the gender of the titles before it, neutral if they
differ. A mention's surrogate is written with its own title, punctuation and capitals.

Collision checks: over the distinct entities of the corpus no surrogate may be taken twice within a type, nor equal any
entity that occurs. Entities that lose are drawn again with the next round number until none does. Names have as many
syllables as their number asks for and, like mail names and domains, grow every few rounds; short IPv6 forms are written in
full and numbers grow if their form has no room left, so any number of entities finds room. All of this is on the table of distinct entities; texts are only read to find mentions and to write surrogates between the parts they split.

Definitions: null texts stay null; texts without mentions stay as they are, byte for byte. Equal texts get equal
results, whatever their doc_id; every input row gives a row. Columns named n_pii or text are replaced, others kept, those
that begin with two underscores and a helper's name (__key, __s) replaced too.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import content_key, join_salted, materialize, spreadable

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}"
SECRET = r"(?<![0-9A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,64}(?![0-9A-Fa-f])"
IPV4 = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d.-])\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}(?!\d)"
#: A shortened address has a digit and is no part of program text, where ``::`` stands between names.
IPV6 = r"(?<![0-9A-Za-z:._])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:_(<])"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
#: Keys with a fixed beginning, which surrogates keep, and a digit.
KEY = r"(?<![A-Za-z0-9])(?=[A-Za-z_-]*[0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:akia|asia)[0-9a-z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?:sk|pk|rk)[-_](?:(?:live|test|proj)[-_])?[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])"
_KEY_START = r"^(?:AKIA|ASIA|akia|asia|gh[pousr]_|(?:sk|pk|rk)[-_](?:(?:live|test|proj)[-_])?|xox[abprs]-|AIza)"
#: Sixteen digits, or other lengths that begin as cards of that length do; a moment in milliseconds is none.
CARD = r"(?<!\d)(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<!\d)(?:\d{16}|4\d{12}|3[068]\d{12}|3[47]\d{13}|[456]\d{16,18})(?!\d)"
#: Titles of address by gender; fixed values.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Κυρία"]
NEUTRAL = ["Mx", "Dr", "Prof"]
_TITLE = rf"(?:{'|'.join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))})\.?"
_NAME_WORD = r"\p{Lu}[\p{L}'-]+"
#: Up to three initials or names before the last name, and one after an only one.
NAME = rf"(?<!\p{{L}}){_TITLE} (?:(?:\p{{Lu}}\. ?|{_NAME_WORD} ){{0,3}}{_NAME_WORD})"
PATTERN = "|".join((EMAIL, KEY, SECRET, IPV6, IPV4, SSN, PHONE, CARD, NAME))
#: Every mention holds one of these or a digit; a quick look that spares most texts the pattern.
_SIGNS = sorted({"@", *(t[:3] if t in ("Señora", "Señor", "господин", "госпожа") else "Mr" if t == "Mrs" else t for t in MALE + FEMALE + NEUTRAL)})
TYPES = ("email", "key", "secret", "ipv6", "ipv4", "ssn", "phone", "card", "name_male", "name_female", "name_neutral", "name_family", "name_given_male", "name_given_female", "name_given_neutral", "domain")
MAX_ROUNDS = 60
ROUNDS_A_SYLLABLE = 3
#: From this round on short IPv6 forms are written in full.
WIDE_ROUND = 3
#: From this round on numbers of fixed form grow too, a digit (or an octet) every few rounds.
GROW_ROUND = 9

#: Alphabets that a letter is redrawn in.
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
_SYLLABLES = {"latin": "ba ce di fo gu ha je ki lo mu na pe ri so tu va".split(), "cyrillic": "ба ве ди го жу за ки ло ма не по ри со ту фа шо".split(), "greek": "βα γε δι ζο θη κα λε μι νο πα ρε σι το φα χε ψι".split()}
_ENDINGS = {"name_given_male": {"latin": "n", "cyrillic": "н", "greek": "ς"}, "name_given_female": {"latin": "lia", "cyrillic": "ля", "greek": "λια"}, "name_given_neutral": {"latin": "ri", "cyrillic": "ри", "greek": "ρι"}}


def holds_mention(text: F.Column) -> F.Column:
    """Whether the pattern occurs; false for null."""
    sign = text.rlike("[0-9]")
    for x in _SIGNS:
        sign |= text.contains(x)
    return F.coalesce(F.when(sign, text.rlike(PATTERN)).otherwise(False), F.lit(False))


def _titled(m: F.Column, titles: list[str]) -> F.Column:
    return m.rlike(rf"^(?:{'|'.join(sorted(titles, key=len, reverse=True))})\.? ")


def mention_type(m: F.Column) -> F.Column:
    """Type of a mention; names are of the gender of their title, without a title of that of a family name."""
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(rf"^(?:{KEY})$"), "key")
        .when(m.rlike(rf"^(?:{SECRET})$"), "secret")
        .when(m.rlike(rf"^(?:{IPV6})$"), "ipv6")
        .when(m.rlike(rf"^(?:{IPV4})$"), "ipv4")
        .when(m.rlike(rf"^(?:{SSN})$"), "ssn")
        .when(m.rlike(rf"^(?:{CARD})$"), "card")
        .when(m.rlike(rf"^(?:{PHONE})$"), "phone")
        .when(_titled(m, MALE), "name_male")
        .when(_titled(m, FEMALE), "name_female")
        .when(_titled(m, NEUTRAL), "name_neutral")
        .otherwise("name_family")
    )


def canonical(m: F.Column, kind: F.Column) -> F.Column:
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(m, r"\D", ""))
        .when(kind.startswith("name"), F.lower(F.regexp_replace(m, rf"^{_TITLE} ", "")))
        .when(kind == "key", m)
        .otherwise(F.lower(m))
    )


def _chars(s: F.Column) -> F.Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), 0)


def _byte(digest: F.Column, i: F.Column) -> F.Column:
    return F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _draw(alphabet: str, n: F.Column) -> F.Column:
    return F.substr(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _redraw(s: F.Column, digest: F.Column, letters: str | None = None) -> F.Column:
    """Letters and digits of s drawn anew in their alphabet and case, other characters kept."""

    def one(c, i):
        b = _byte(digest, i)
        if letters:
            return F.when(c.rlike("[0-9a-f]"), _draw(letters, b)).otherwise(c)
        return (
            F.when(c.rlike("[0-9]"), _draw("0123456789", b))
            .when(c.rlike("[A-Z]"), _draw(LATIN.upper(), b))
            .when(c.rlike(r"\p{IsCyrillic}"), _draw(CYRILLIC, b))
            .when(c.rlike(r"\p{IsGreek}"), _draw(GREEK, b))
            .when(c.rlike(r"\p{L}"), _draw(LATIN, b))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(s), one), "")


def _luhn(digits: F.Column) -> F.Column:
    """Luhn sum modulo 10 of a string of digits."""
    back = F.reverse(_chars(digits))
    doubled = F.transform(back, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10


def _name(canon: F.Column, kind: F.Column, digest: F.Column, syllables: int) -> F.Column:
    """One word: a family name of so many syllables, or a given name with the ending of its gender; a hyphen stays one."""

    def in_script(script: str) -> F.Column:
        known = F.array(*map(F.lit, _SYLLABLES[script]))
        part = lambda i: F.element_at(known, _byte(digest, F.lit(i)) % 16 + 1)
        end = F.lit("")
        for k, by in _ENDINGS.items():
            end = F.when(kind == k, by[script]).otherwise(end)
        hyphen = F.when(canon.contains("-"), "-").otherwise("")
        return F.concat(*(part(i) for i in range(2)), hyphen, *(part(i) for i in range(2, syllables)), end)

    return F.when(canon.rlike(r"\p{IsCyrillic}"), in_script("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), in_script("greek")).otherwise(in_script("latin"))


def _hmac(key: str, message: F.Column) -> F.Column:
    """HMAC-SHA256 in hexadecimal."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def draw(canon: F.Column, kind: F.Column, round_no: int, key: str, syllables: int = 4) -> F.Column:
    """The surrogate (canonical form) of an entity in a round. An e-mail's canonical form holds its surrogate domain."""
    h = F.concat(*(_hmac(key, F.concat_ws("|", kind, F.lit(str(round_no)), F.lit(str(i)), canon)) for i in (0, 1)))
    more = _redraw(F.lit("x" * (round_no // ROUNDS_A_SYLLABLE)), F.reverse(h))
    label, last = F.substring_index(canon, ".", 1), F.substring_index(canon, ".", -1)
    domain = F.concat(_redraw(label, h), more, F.lit(".example."), F.when(last.isin("com", "org", "net"), last).otherwise("com"))
    mail = F.concat(_redraw(F.substring_index(canon, "@", 1), h), more, F.lit("@"), F.substring_index(canon, "@", -1))
    grown = max(0, round_no - GROW_ROUND + ROUNDS_A_SYLLABLE) // ROUNDS_A_SYLLABLE
    octets = F.concat_ws(".", (_byte(h, F.lit(0)) % 15 + 240).cast("string"), *(_byte(h, F.lit(i)).cast("string") for i in range(1, 4 + grown)))
    wide = F.regexp_replace(F.substr(h, F.lit(1), F.lit(32)), "(.{4})(?!$)", "$1:")
    ipv6 = _redraw(canon, h, "0123456789abcdef") if round_no < WIDE_ROUND else F.when(F.length(F.regexp_replace(canon, ":", "")) < 16, wide).otherwise(_redraw(canon, h, "0123456789abcdef"))
    number = _redraw(F.concat(canon, F.lit("0" * grown)), h)
    # the check digit moves by what keeps the Luhn sum of the original
    body = F.substr(number, F.lit(1), F.length(number) - 1)
    wrong = _luhn(F.concat(body, F.lit("0")))
    card = F.concat(body, ((F.when(_luhn(canon) == 0, 10 - wrong).otherwise(11 + _byte(h, F.lit(63)) % 9 - wrong)) % 10).cast("string"))
    country = F.when(F.length(canon) > 10, F.substr(canon, F.lit(1), F.length(canon) - 10)).otherwise("")
    phone = F.concat(country, F.substr(number, F.length(country) + 1, F.length(number)))
    ssn = F.concat(F.lit("9"), F.substr(number, F.lit(2), F.length(number)))
    start = F.regexp_extract(canon, _KEY_START, 0)
    return (
        F.when(kind == "email", mail)
        .when(kind == "domain", domain)
        .when(kind == "ipv4", octets)
        .when(kind == "secret", _redraw(canon, h, "0123456789abcdef"))
        .when(kind == "ipv6", ipv6)
        .when(kind == "key", F.concat(start, _redraw(F.substr(canon, F.length(start) + 1, F.length(canon)), h)))
        .when(kind == "card", card)
        .when(kind == "ssn", ssn)
        .when(kind == "phone", phone)
        .otherwise(_name(canon, kind, h, syllables + round_no // ROUNDS_A_SYLLABLE))
    )


def assign(entities: DataFrame, key: str, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(kind, canon) distinct -> (kind, canon, surrogate): all different within a kind and from every entity."""
    kind = F.col("kind")
    family = F.when(kind.startswith("name"), "name").otherwise(kind)  # names share one space
    pending, done = entities.withColumn("family", family), None
    names = entities.where(kind.startswith("name")).count()
    syllables = max(4, math.ceil(math.log2(names + 1) / 4) + 1)  # 16 times as many as there are names
    real = pending.select("family", F.col("canon").alias("surrogate")).distinct()
    for r in range(max_rounds):
        drawn = materialize(pending.withColumn("surrogate", draw(F.col("canon"), kind, r, key, syllables) if names else draw(F.col("canon"), kind, r, key)), "drawn")
        free = drawn.join(real, ["family", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done, ["family", "surrogate"], "left_anti")
        first = free.groupBy("family", "surrogate").agg(F.min(F.struct("canon", "kind")).alias("w"))
        won = first.select("family", "surrogate", F.col("w")["canon"].alias("canon"), F.col("w")["kind"].alias("kind"))
        done = materialize(won if done is None else done.unionByName(won), "surrogates")
        lost = drawn.join(done, ["kind", "canon"], "left_anti")
        if lost.isEmpty():
            return done.select("kind", "canon", "surrogate")
        pending = lost.drop("surrogate")
    raise RuntimeError(f"no distinct surrogates for all entities in {max_rounds} rounds")


def name_words(m: F.Column) -> F.Column:
    """Words of a name without its title, as they are written; an initial is a word."""
    return F.split(F.regexp_replace(F.regexp_replace(m, rf"^{_TITLE} ", ""), r"\.(?=\p{L})", ". "), " ")


def is_initial(word: F.Column) -> F.Column:
    return word.rlike(r"^\p{L}\.$")


def _case_like(original: F.Column, surrogate: F.Column) -> F.Column:
    """The surrogate with capitals where the original has them."""
    raised = F.zip_with(_chars(original), _chars(surrogate), lambda o, s: F.when((o == F.upper(o)) & (o != F.lower(o)), F.upper(s)).otherwise(F.coalesce(s, F.lit(""))))
    return F.array_join(raised, "")


def render(m: F.Column, kind: F.Column, surrogate: F.Column) -> F.Column:
    """A surrogate in the punctuation and capitals of a mention that is no name."""
    gaps = F.split(m, r"\d", -1)
    digits = F.concat(_chars(surrogate), F.array(F.lit("")))
    spaced = F.array_join(F.zip_with(gaps, digits, lambda g, d: F.concat(F.coalesce(g, F.lit("")), F.coalesce(d, F.lit("")))), "")
    local, domain = F.substring_index(surrogate, "@", 1), F.substring_index(surrogate, "@", -1)
    host, top = F.substring_index(F.substring_index(m, "@", -1), ".", 1), F.substring_index(m, ".", -1)
    middle = F.substr(domain, F.length(F.substring_index(domain, ".", 1)) + 1, F.length(domain) - F.length(F.substring_index(domain, ".", 1)) - F.length(F.substring_index(domain, ".", -1)))
    mail = F.concat(_case_like(F.substring_index(m, "@", 1), local), F.lit("@"), _case_like(host, F.substring_index(domain, ".", 1)), middle, _case_like(top, F.substring_index(domain, ".", -1)))
    cased = F.when((kind != "key") & (m == F.upper(m)) & (m != F.lower(m)), F.upper(surrogate)).when((kind == "email") & (m != F.lower(m)), mail).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "ssn"), spaced).otherwise(cased)


def _cased(word: F.Column, surrogate: F.Column) -> F.Column:
    return F.when(word == F.upper(word), F.upper(surrogate)).when(word == F.lower(word), F.lower(surrogate)).otherwise(F.initcap(surrogate))


def name_surrogates(named: DataFrame, key: str) -> DataFrame:
    """(m, s) of mentions that are names: each word's surrogate behind the mention's own title."""
    words = named.select("m", "kind", F.posexplode(name_words(F.col("m"))).alias("place", "word"), F.size(name_words(F.col("m"))).alias("n"))
    words = materialize(words.withColumn("canon", F.lower("word")), "name-words")
    # initials are too few to be kept apart: each is a letter of the same script, drawn by itself
    h = _hmac(key, F.concat_ws("|", F.lit("initial"), "canon"))
    initials = words.where(is_initial(F.col("word"))).select("m", "place", F.upper(_redraw(F.col("canon"), h)).alias("s"))
    words = words.where(~is_initial(F.col("word")))
    given = (F.col("n") > 1) & (F.col("place") == 0)
    uses = words.groupBy("canon").agg(
        F.max(given).alias("given"), F.coalesce(F.max(given & (F.col("kind") == "name_male")), F.lit(False)).alias("male"), F.coalesce(F.max(given & (F.col("kind") == "name_female")), F.lit(False)).alias("female")
    )
    kind = F.when(~F.col("given"), "name_family").when(F.col("male") & ~F.col("female"), "name_given_male").when(F.col("female") & ~F.col("male"), "name_given_female").otherwise("name_given_neutral")
    surrogates = assign(uses.select(kind.alias("kind"), "canon"), key)
    written = join_salted(words, surrogates.select("canon", "surrogate"), ["canon"], ["m", "place"])
    written = written.select("m", "place", _cased(F.col("word"), F.col("surrogate")).alias("s")).union(initials)
    whole = written.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("place", "s"))).alias("x"))
    title = F.regexp_extract("m", rf"^{_TITLE} ", 0)
    return whole.select("m", F.concat(title, F.array_join(F.transform("x", lambda w: w["s"]), " ")).alias("s"))


def other_surrogates(named: DataFrame, key: str) -> DataFrame:
    """(m, s) of all other mentions; mail domains first, as entities of their own."""
    mails = named.where("kind = 'email'").withColumn("domain", F.substring_index("canon", "@", -1))
    domains = assign(mails.select(F.lit("domain").alias("kind"), F.col("domain").alias("canon")).distinct(), key)
    local = F.substring_index("canon", "@", 1)
    mails = join_salted(mails, domains.select(F.col("canon").alias("domain"), F.col("surrogate").alias("to")), ["domain"], ["m"])
    mails = mails.select("m", "kind", F.concat(local, F.lit("@"), "to").alias("canon"))
    named = materialize(named.where("kind <> 'email'").select("m", "kind", "canon").union(mails), "entities")
    surrogates = assign(named.select("kind", "canon").distinct(), key)
    return named.join(surrogates, ["kind", "canon"]).select("m", render(F.col("m"), F.col("kind"), F.col("surrogate")).alias("s"))


def known_names(mentions: F.Column) -> F.Column:
    """Pattern of the full and family names among a text's mentions, without titles, as written or in capitals, full names
    in small letters too; null if there are none."""
    names = F.filter(mentions, lambda m: m.rlike(rf"^{_TITLE} "))
    full = F.transform(names, lambda m: F.array_join(name_words(m), " "))
    forms = F.concat(full, F.transform(names, lambda m: F.element_at(name_words(m), -1)))
    forms = F.concat(forms, F.transform(forms, lambda x: F.upper(x)), F.filter(F.transform(full, lambda x: F.lower(x)), lambda x: x.contains(" ")))
    forms = F.transform(forms, lambda x: F.replace(x, F.lit("."), F.lit("\\.")))
    forms = F.array_sort(F.array_distinct(forms), lambda a, b: F.length(b) - F.length(a))
    return F.when(F.size(names) > 0, F.concat(F.lit(r"|(?<![\p{L}\p{N}])(?:"), F.array_join(forms, "|"), F.lit(r")(?![\p{L}\p{N}])")))


def replace_pii(documents: DataFrame, key: str) -> DataFrame:
    """``documents`` with mentions in text replaced and n_pii, their number (long).

    The pattern runs over all texts twice: to set those with mentions apart, and to pass the others on.
    """
    kept = [c for c in documents.columns if c not in ("n_pii", "text", "__key", "__s", "__names")]
    has = holds_mention(F.col("text"))
    some = materialize(documents.where(has).select(*kept, "text").withColumn("__key", content_key("text")), "with-mentions")
    found = some.select("__key", "text", F.regexp_extract_all("text", F.lit(PATTERN), 0).alias("mentions"))
    found = found.withColumn("names", known_names(F.col("mentions")))
    # texts with names are searched again for these names without a title
    again = F.regexp_extract_all("text", F.concat(F.lit(PATTERN), "names"), 0)
    found = found.select("__key", "names", F.when(F.col("names").isNull(), F.col("mentions")).otherwise(again).alias("mentions"))
    found = materialize(found.dropDuplicates(["__key"]), "mentions")  # texts with mentions, once each
    named = found.select(F.explode("mentions").alias("m")).distinct().withColumn("kind", mention_type(F.col("m"))).withColumn("canon", canonical(F.col("m"), F.col("kind")))
    named = materialize(named, "named")
    is_name = F.col("kind").startswith("name")
    written = materialize(name_surrogates(named.where(is_name), key).union(other_surrogates(named.where(~is_name), key)), "written")
    parts = join_salted(found.select("__key", F.posexplode("mentions").alias("pos", "m")), written, ["m"], ["__key", "pos"])
    parts = parts.groupBy("__key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("__s"))
    parts = materialize(parts.join(found.select("__key", "names"), "__key").select("__key", "__s", F.col("names").alias("__names")), "parts")

    changed = join_salted(some, parts, ["__key"], spreadable(some, ("text",)))
    plain, mixed = F.split("text", PATTERN, -1), F.split("text", F.concat(F.lit(PATTERN), "__names"), -1)
    gaps = F.when(F.col("__names").isNull(), plain).otherwise(mixed)
    text = F.array_join(F.flatten(F.zip_with(gaps, F.concat("__s", F.array(F.lit(""))), lambda g, s: F.array(g, s))), "")
    changed = changed.select(*kept, F.size("__s").cast("long").alias("n_pii"), text.alias("text"))
    return changed.union(documents.where(~has).select(*kept, F.lit(0).cast("long").alias("n_pii"), "text"))


def op4_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced. The key is the session's ``spark.tracewright.surrogateKey``; the
    example key stands in only where that is unset."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_pii(documents, key=spark.conf.get("spark.tracewright.surrogateKey", "example-key"))
