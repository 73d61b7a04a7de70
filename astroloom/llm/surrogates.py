"""Operator 6, surrogate generation for personal data, natively.

Detected entities are replaced by keyed, type-consistent surrogates: e-mail
addresses, phone numbers, IPv4 and IPv6 addresses, payment cards, social
security numbers, account numbers, credentials and personal names. A surrogate
keeps its value's format (digits for digits, letters for letters of the same
case and script, separators, country codes and top-level domains as they are,
valid check digits for valid ones); names keep title, gender and script. No
pattern has a length limit that would leave a value's tail in the text. What
only looks like a card (its Luhn sum is wrong) or an account number (its
remainder of 97 is) is no entity.

A name is found by a title, a listed given name or a label (``name:``) before
it; Chinese names by a family name before a title. A second pass replaces every
bare mention of a document's found given names and surnames by the same map
(parts of a hyphenated word too), and counts it.

Coreference: a surrogate depends on the key, the kind and the value only, so a
value has one surrogate in the whole corpus; names are mapped word by word, so
that a full name and a mention by surname agree. Distinctness: listed given
names move along one cycle through their list, whose order the key decides,
which is one to one; every other kind is checked over the corpus: of the values
that share a surrogate one keeps it, as do none that met an original value, and
the rest draw again (longer where the format lets them) for ``ROUNDS`` rounds. A
value whose format has no free surrogate left then gets its kind and 128 keyed
bits: the format goes, never the distinctness or the job.

The key is the caller's; there is none to fall back on in ``pseudonymise``.

Only entities are exploded and joined; values that hold more than one 4,096th
of them are joined by broadcast (there are fewer than 4,096 such values). A text
is shuffled once, by its key. Only DataFrame functions are used.

Results in unusual cases: null text stays null with no entities; empty texts
stay; a text that is one entity is replaced whole; very long texts are read
whole; repeated rows stay and agree; a null ``doc_id`` is kept; an empty table
gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_key, settle, table, text_key

#: Where the contract query takes its key from.
KEY_SETTING = "spark.astroloom.surrogates.key"
#: Its key where that setting is missing: for trials on made-up data only.
TRIAL_KEY = "for trials on made-up data"

#: Given names by script and gender; a list is closed under replacement.
GIVEN = {
    "latin_m": (
        "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Kevin "
        "Brian George Edward Peter Hans Klaus Pierre Jacques Carlos Miguel José Juan Luis Paul Mark Stephen Henry Jack "
        "Ahmed Ali Mohammed Omar Hassan Ibrahim Raj Amit Rahul Vikram Arjun Wei Hiroshi Kenji Giovanni Marco Luca Jan Piotr Lars Sven"
    ),
    "latin_f": (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Emily Donna Michelle "
        "Laura Anna Emma Sophie Greta Ursula Claire Camille Carmen Lucia María Alice Jane Helen Julia Olivia Grace Lisa "
        "Aisha Fatima Amina Leila Zainab Priya Anjali Deepa Sunita Kavita Mei Yuki Keiko Giulia Francesca Elena Agnieszka Ingrid Astrid"
    ),
    "cyrillic_m": "Иван Дмитрий Сергей Алексей Николай Михаил Владимир Андрей Павел Борис",
    "cyrillic_f": "Мария Анна Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила",
}
MALE_TITLES = "Mr Herr Monsieur Señor Sir السيد"
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Señora السيدة"
OTHER_TITLES = "Dr Prof الدكتور الدكتورة"
#: Particles that belong to a surname.
PARTICLES = "van der|van den|van|von der|von|de la|del|de|di|da|dos|bin|ibn"
LABELS = "name:|name is|contact:|patient:|customer:|employee:|author:|signed:|attn:"

#: Capitalised words after a name at a sentence's end; they are no names.
NOT_NAMES = (
    "The This That These Those He She It They We You His Her Its Their Our Your My And But Or So If In On At As Of To For "
    "From With By Then There Here When While Where What Who Why How Not No Yes After Before Der Die Das Ein Eine Und Le La "
    "Les Un Une Et El Los Las Una Est Er Sie Es Wir Ich Il Elle"
).split()


def _any_of(names: str) -> str:
    """An alternation by first letters, so that few branches are tried."""
    groups: dict[str, list[str]] = defaultdict(list)
    for name in names.split():
        groups[name[0]].append(name[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in groups.items())


_U, _L = r"[\p{IsLatin}&&\p{Lu}]", r"[\p{IsLatin}&&\p{Ll}]"
_LATIN_TITLES = " ".join(t for t in f"{MALE_TITLES} {FEMALE_TITLES} {OTHER_TITLES}".split() if t[0] < "Ā")
_ARABIC_TITLES = "|".join(t for t in f"{FEMALE_TITLES} {MALE_TITLES} {OTHER_TITLES}".split() if t[0] >= "Ā")
_TITLE = _any_of(_LATIN_TITLES)
_LATIN = _any_of(f"{GIVEN['latin_m']} {GIVEN['latin_f']}")
_CYRILLIC = _any_of(f"{GIVEN['cyrillic_m']} {GIVEN['cyrillic_f']}")
#: O'Neil, McDonald, Smith-Jones.
_SURNAME = rf"(?:{_U}['’])?{_U}{_L}++(?:['’-]?{_U}{_L}++){{0,3}}+"
_CYRILLIC_SURNAME = r"[А-ЯЁ][а-яё]++(?:-[А-ЯЁ][а-яё]++){0,3}+"
_LAST = rf"(?:(?:{PARTICLES}) )?(?!(?:{'|'.join(NOT_NAMES)})(?!\p{{L}})){_SURNAME}"
_INITIALS = rf"(?: {_U}\.){{0,3}}"
_LATIN_NAME = (
    rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE})\.? (?:{_SURNAME}{_INITIALS} )?{_LAST}|(?:{_LATIN}){_INITIALS} {_LAST}"
    rf"|(?<=(?i:{LABELS}) ){_SURNAME}{_INITIALS} {_LAST})(?!{_L})"
)
_CYRILLIC_NAME = rf"(?<![а-яёА-ЯЁ])(?:{_CYRILLIC}) {_CYRILLIC_SURNAME}"
_ARABIC_NAME = rf"(?<!\p{{L}})(?:{_ARABIC_TITLES}) [\u0621-\u064A]{{2,}}+(?: [\u0621-\u064A]{{2,}}+)?"
#: Common Chinese family names, one character each.
HAN_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧"
_HAN_NAME = rf"[{HAN_SURNAMES}]\p{{IsHan}}{{1,2}}?(?=先生|女士|小姐|教授|博士|老师)"
#: A word that may be a bare mention of a name.
MENTION = rf"(?<![\p{{L}}\d_])(?:{_SURNAME}|{_CYRILLIC_SURNAME}|[\u0621-\u064A]{{2,}}+)(?![\p{{L}}\d_])"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
_LOCAL = r"[\p{L}\p{N}._%+-]++"

#: kind -> pattern; the first that matches at a place wins.
PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-]){_LOCAL}(?:'{_LOCAL}){{0,3}}@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++){{0,125}}\.\p{{L}}{{2,}}",
    "credential": (
        r"\b(?:AKIA[0-9A-Z]{16}|(?i:password|passwd|secret|token|api[_-]?key)(?: {0,2}= {0,2}|:(?= {0,2}\S*\d) {0,2})"
        r"(?:\"[^\"\s]{6,}+|'[^'\s]{6,}+|[^\s\"'<>,;)]{8,}+))"
    ),
    "phone": (
        r"(?:(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
        r"|(?<![\d.-])(?:\d{3}[-.]\d{3}[-.]\d{4}|\d{3} \d{3} \d{4}|0\d{2,4} \d{3,4} \d{3,4}|0\d{2,4}-\d{3,4}-\d{3,4})(?![\d-]|\.\d))"
    ),
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\w.])(?<!(?i:version|release|ver|ver\.) ){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)",
    "ipv6": (
        rf"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?"
        rf"|::{_HEX}(?::{_HEX}){{1,6}})(?![\w:])"
    ),
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<!\d)[2-6](?:[ -]?\d){12,18}(?!\d)",
    "name": f"{_LATIN_NAME}|{_CYRILLIC_NAME}|{_ARABIC_NAME}|{_HAN_NAME}",
}
#: All patterns, tried only where their first character stands: few positions
#: of a text are more than a look behind and one ahead.
ANY = "|".join(
    (
        "(?<![A-Za-z])(?:"
        + "|".join(
            (
                PATTERNS["email"],
                f"(?=[0-9A-Fa-f]{{0,4}}:)(?:{PATTERNS['ipv6']})",
                f"(?=[AaPpSsTt])(?:{PATTERNS['credential']})",
                rf"(?=[A-Z]|\p{{Lu}})(?:{PATTERNS['iban']}|{_LATIN_NAME}|{_CYRILLIC_NAME})",
                rf"(?=[\u0621-\u064A])(?:{_ARABIC_NAME})",
            )
        )
        + ")",
        "(?=[0-9+(])(?:" + "|".join(PATTERNS[k] for k in ("phone", "ssn", "ip", "card")) + ")",
        rf"(?=[\u4E00-\u9FFF])(?:{_HAN_NAME})",
    )
)

_STEMS = "Bal Ber Bran Cal Car Cor Dal Dor Fen Fer Gal Gar Hal Hol Jor Kel Lan Lor Mar Mer Nor Oll Pel Ran Ros Sal Sel Tal Tor Val Ver Wil".split()
_MIDDLES = "ba be bi da de di ga ge ka ke la le li ma me mi na ne ni ra re ri sa se ta te ti va ve vi wa we".split()
_ENDS = "son ton man ley well ford field wood by den ham ler mer ner ser ter berg stein feld mann dal gren lund qvist roy lier ret nez rez dez les ros".split()
_CYR_STEMS = "Бал Бор Вал Вер Гал Гор Дан Дор Жар Зим Кал Кор Лав Лес Мар Мир Нов Ол Пав Пет Рад Род Сав Сел Тар Тим Фед Фил Хар Чер Шам Яр".split()
_CYR_ENDS_M, _CYR_ENDS_F = "ов ев ин ский енко".split(), "ова ева ина ская енко".split()
_HAN_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超霞平刚桂英华玉兰红文志建国春梅海燕雪峰宇晨欣怡"
_ARABIC_M = "أحمد محمود خالد سعيد يوسف طارق ناصر كريم فارس ماجد سامي رامي عادل جمال حسام زياد".split()
_ARABIC_F = "مريم سلمى نور هدى ريم دانا سارة لينا هالة رنا منى سمر ندى جنى رغد عبير".split()
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYR_LOWER, _CYR_UPPER = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"

#: Kinds whose surrogates are one to one by construction.
CLOSED = ("given_latin_m", "given_latin_f", "given_cyrillic_m", "given_cyrillic_f", "initial", "keep", "none")
#: Draws before a value gives up its format.
ROUNDS = 12
#: A value is a hot one from this part of all entities on.
HOT_PART = 4096


def _in(word: Column, names: str) -> Column:
    return F.array_contains(F.split(F.lit(names), " "), word)


def _pick(items: list[str], n: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(items)), " "), (F.pmod(n, F.lit(len(items))) + 1).cast("int"))


def _letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def cycle(names: list[str], key: str, kind: str) -> dict[str, str]:
    """One cycle through a list, in an order that only the key tells: one to
    one, and no name stays itself."""
    order = sorted(names, key=lambda x: hashlib.sha256("\x1f".join((key, kind, x)).encode()).digest())
    return dict(zip(order, order[1:] + order[:1], strict=True))


def parts_of(kind: Column, value: Column) -> Column:
    """array<struct<kind, value>> of an entity: names by word, others whole."""
    words = F.split(value, " ")
    first = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
    titled = _in(first, f"{MALE_TITLES} {FEMALE_TITLES} {OTHER_TITLES}")
    woman = _in(first, f"{FEMALE_TITLES} الدكتورة") | _in(first, GIVEN["latin_f"]) | _in(first, GIVEN["cyrillic_f"])
    particles = sorted(set(PARTICLES.replace("|", " ").split()))

    def of(word: Column, i: Column) -> Column:
        last = i == F.size(words) - 1
        k = F.lit("surname")
        k = F.when(word.rlike("[А-Я]"), F.when(woman, F.lit("surname_cyrillic_f")).otherwise("surname_cyrillic_m")).otherwise(k)
        k = F.when(word.rlike("[\u0621-\u064A]"), F.when(woman, F.lit("arabic_f")).otherwise("arabic_m")).otherwise(k)
        k = F.when(word.rlike(r"\p{IsHan}"), F.lit("han")).otherwise(k)
        # A given name that is in no list: after a title, before the surname.
        k = F.when((k == "surname") & ~last & titled & (i == 1), F.when(woman, "given_new_f").otherwise("given_new_m")).otherwise(k)
        for name, names in GIVEN.items():
            k = F.when(_in(word, names) & ~(titled & last & (F.size(words) > 2)), F.lit(f"given_{name}")).otherwise(k)
        k = F.when(word.rlike(r"^\p{Lu}\.$"), F.lit("initial")).otherwise(k)
        k = F.when((i == 0) & titled | word.isin(particles), F.lit("keep")).otherwise(k)
        return F.struct(k.alias("kind"), word.alias("value"))

    return F.when(kind == "name", F.transform(words, of)).otherwise(
        F.array(F.struct(kind.alias("kind"), value.alias("value")))
    )


def _shaped(value: Column, digest: Column, kept: Column, until: Column, hexed: Column) -> Column:
    """``value`` with its characters after place ``kept`` and up to ``until`` drawn anew."""

    def draw(i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        n = F.conv(F.substring(digest, F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")
        n = n + F.floor(i / 63).cast("int") * 7
        letter = F.when(hexed & c.rlike("[a-f]"), _letter(_LOWER[:6], n)).when(hexed & c.rlike("[A-F]"), _letter(_UPPER[:6], n))
        for some, alphabet in (
            ("[a-z]", _LOWER), ("[A-Z]", _UPPER), ("[а-яё]", _CYR_LOWER), ("[А-ЯЁ]", _CYR_UPPER), (r"\p{IsHan}", _HAN_GIVEN),
            (r"\p{Lu}", _UPPER), (r"\p{L}", _LOWER),
        ):
            letter = letter.when(c.rlike(some), _letter(alphabet, n))
        return F.when((i <= kept) | (i > until), c).when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string")).otherwise(
            F.coalesce(letter, c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), draw), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of an array of digits, the last one counted once."""
    return F.aggregate(
        F.transform(
            F.reverse(digits),
            lambda d, i: F.when(F.pmod(i, F.lit(2)) == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def _digits(value: Column) -> Column:
    plain = F.regexp_replace(value, "[^0-9]", "")
    return F.transform(F.sequence(F.lit(1), F.length(plain)), lambda i: F.substring(plain, i, F.lit(1)).cast("int"))


def _remainder(code: Column) -> Column:
    """An account number's remainder of 97: its first four characters last,
    letters as 10 to 35."""
    plain = F.regexp_replace(code, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    numbers = F.transform(
        F.sequence(F.lit(1), F.length(turned)),
        lambda i: F.conv(F.substring(turned, i, F.lit(1)), 36, 10).cast("int"),
    )
    return F.aggregate(numbers, F.lit(0), lambda a, x: F.pmod(a * F.when(x > 9, 100).otherwise(10) + x, F.lit(97)))


def _account(drawn: Column) -> Column:
    """The check digits that make a drawn account number valid."""
    plain = F.concat(F.substring(drawn, 1, 2), F.lit("00"), F.substring(drawn, F.lit(5), F.length(drawn)))
    check = F.lpad((98 - _remainder(plain)).cast("string"), 2, "0")
    return F.concat(F.substring(drawn, 1, 2), check, F.substring(drawn, F.lit(5), F.length(drawn)))


def genuine(kind: Column, value: Column) -> Column:
    """Whether check digits bear out what a value looks like."""
    card = F.pmod(_luhn(_digits(value)), F.lit(10)) == 0
    return F.when(kind == "card", card).when(kind == "iban", _remainder(value) == 1).otherwise(True)


def with_surrogate(values: DataFrame, attempt: int, key: str) -> DataFrame:
    """``values`` (kind, value, ...) with the ``surrogate`` of a given draw."""
    kind, value, digest = F.col("kind"), F.col("value"), F.col("digest")
    top = F.length(F.substring_index(value, ".", -1)) + 1
    code = F.length(F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])|^\+", 0))
    secret = F.length(F.regexp_extract(value, r"^(?:AKIA|[A-Za-z_-]+ {0,2}[=:] {0,2}[\"']?)", 0))
    kept = F.when(kind == "phone", code).when(kind == "credential", secret).when(kind == "card", 1).when(kind == "iban", 2).otherwise(0)
    until = F.length(value) - F.when(kind == "email", top).otherwise(0)
    hexed = (kind == "ipv6") | (kind == "credential") & F.substring(value, secret + 1, F.length(value)).rlike("^[0-9a-f]+$")
    values = values.withColumn("digest", F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, F.lit(str(attempt))), 512))
    values = values.withColumn("drawn", _shaped(value, digest, kept, until, hexed))
    drawn = F.col("drawn")
    number = [F.conv(F.substring(digest, 1 + 6 * i, 6), 16, 10).cast("int") for i in range(8)]
    more = str(10 + attempt) if attempt >= 4 else ""  # a longer draw where a format's values run out
    # The last digit is set so that the number is valid again.
    digits = _digits(drawn)
    tail = F.pmod(10 - F.pmod(_luhn(F.concat(F.slice(digits, F.lit(1), F.size(digits) - 1), F.array(F.lit(0)))), F.lit(10)), F.lit(10))
    middles = [_pick(_MIDDLES, n) for n in number[2 : 2 + min(5, 1 + attempt)]]
    stem = _pick(_STEMS, number[0])
    out = F.when(kind.isin("keep", "none"), value)
    maps = {f"given_{name}": cycle(names.split(), key, name) for name, names in GIVEN.items()}
    maps["initial"] = cycle([f"{c}." for c in _UPPER], key, "initial")
    for name, moved in maps.items():
        entries = F.str_to_map(F.lit(",".join(f"{a}:{b}" for a, b in sorted(moved.items()))), F.lit(","), F.lit(":"))
        out = out.when(kind == name, F.coalesce(F.try_element_at(entries, value), value))
    out = out.when(kind == "given_new_f", F.concat(stem, *middles, F.lit("a")))
    out = out.when(kind == "given_new_m", F.concat(stem, *middles, F.lit("n")))
    out = out.when(kind == "surname", F.concat(stem, *middles, _pick(_ENDS, number[1])))
    for g, ends in (("m", _CYR_ENDS_M), ("f", _CYR_ENDS_F)):
        longer = [F.lower(_pick(_CYR_STEMS, n)) for n in number[2 : 2 + min(5, attempt + 1)]]
        out = out.when(kind == f"surname_cyrillic_{g}", F.concat(_pick(_CYR_STEMS, number[0]), *longer, _pick(ends, number[1])))
    for g, names in (("m", _ARABIC_M), ("f", _ARABIC_F)):
        out = out.when(kind == f"arabic_{g}", F.concat(*[_pick(names, n) for n in number[: 2 + min(4, attempt)]]))
    given = [_letter(_HAN_GIVEN, n) for n in number[1:7]]
    size = F.least(F.lit(6), F.greatest(F.lit(1), F.length(value) - 1) + max(0, attempt - 2))
    out = out.when(kind == "han", F.concat(_letter(HAN_SURNAMES, number[0]), F.substring(F.concat(*given), F.lit(1), size)))
    out = out.when(kind == "email", F.regexp_replace(drawn, "@", f"{more}@"))
    out = out.when(kind == "ip", F.concat_ws(".", *[(F.pmod(n, F.lit(254)) + 1).cast("string") for n in number[:4]]))
    out = out.when(kind == "card", F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), tail.cast("string")))
    out = out.when(kind == "iban", _account(drawn)).otherwise(drawn)
    return values.withColumn("surrogate", out).drop("digest", "drawn")


def assign(values: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, n, surrogate) of each (kind, value) and its number of
    rows; no two values of a kind have one surrogate, none another's original
    (unless a format ran out, see the module's head)."""
    values = settle(values.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))
    closed = values.where(F.col("kind").isin(*CLOSED))
    done = with_surrogate(closed, 0, key)
    originals = values.select("kind", F.col("value").alias("surrogate"))
    pending = values.where(~F.col("kind").isin(*CLOSED))
    for attempt in range(rounds):
        drawn = with_surrogate(pending, attempt, key)
        winners = (
            drawn.join(originals, ["kind", "surrogate"], "left_anti")
            .join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
            .groupBy("kind", "surrogate")
            .agg(F.min_by(F.struct("value", "n"), "value").alias("won"))
            .select("kind", "won.value", "won.n", "surrogate")
        )
        winners = settle(winners)
        done = done.unionByName(winners)
        pending = pending.join(winners.select("kind", "value"), ["kind", "value"], "left_anti")
        if pending.isEmpty():
            return done
        pending = settle(pending)
    bits = F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("last"), "kind", "value"), 256), 1, 32)
    return done.unionByName(pending.withColumn("surrogate", F.concat_ws("-", "kind", bits)))


def entities(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, pos, kind, value): every match in every text, in order; its
    kind is ``none`` where check digits speak against it."""
    k1, k2 = text_key(F.col("text"))
    value = F.col("value")
    kind = reduce(
        lambda rest, k: F.when(value.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(rest),
        reversed(list(PATTERNS)),
        F.lit("name"),
    )
    found = (
        docs.select(id_key(F.col("doc_id")).alias("id"), k1.alias("k1"), k2.alias("k2"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("found"))
        .where(F.size("found") > 0)
        .select("id", "k1", "k2", F.posexplode("found").alias("pos", "value"))
        .select("id", "k1", "k2", "pos", kind.alias("kind"), "value")
    )
    return found.withColumn("kind", F.when(genuine(F.col("kind"), value), F.col("kind")).otherwise("none"))


def _own_names(found: Column) -> Column:
    """map<word, surrogate> of a text's given names and surnames."""
    words = F.flatten(F.transform(F.filter(found, lambda x: x["entity"] == "name"), lambda x: x["words"]))
    words = F.transform(words, lambda w: F.struct(w["value"].alias("value"), w["kind"].alias("kind"), w["surrogate"].alias("surrogate")))
    names = F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w["kind"].isin("keep", "initial") & ~w["value"].isin(NOT_NAMES))))
    # A word of two kinds counts as the first.
    ones = F.filter(names, lambda w, i: (i == 0) | (F.get(names, i - 1)["value"] != w["value"]))
    return F.map_from_entries(F.transform(ones, lambda w: F.struct(w["value"], w["surrogate"])))


def _mentions(gap: Column, names: Column) -> tuple[Column, Column]:
    """A text between entities with its bare mentions of ``names`` replaced,
    and their number."""
    tokens = F.regexp_extract_all(gap, F.lit(MENTION), F.lit(0))

    def known(x: Column) -> Column:
        return F.map_contains_key(names, x)

    def new(token: Column) -> Column:
        parts = F.transform(F.split(token, "-"), lambda x: F.when(known(x), names[x]).otherwise(x))
        return F.when(known(token), names[token]).otherwise(F.array_join(parts, "-"))

    pieces = F.transform(
        F.split(gap, MENTION, -1),
        lambda g, i: F.concat(g, F.when(i < F.size(tokens), new(F.get(tokens, i))).otherwise("")),
    )
    met = F.filter(tokens, lambda x: known(x) | F.exists(F.split(x, "-"), known))
    return F.array_join(pieces, ""), F.size(met)


def _joined(parts: DataFrame, mapped: DataFrame) -> DataFrame:
    """``parts`` with the surrogate of each (kind, value). What more than one
    part in ``HOT_PART`` holds is broadcast: less than ``HOT_PART`` values."""
    total = mapped.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    key = ["kind", "value"]
    hot = F.broadcast(mapped.where(F.col("n") > total // HOT_PART).drop("n"))
    rest = parts.join(hot.select(*key), key, "left_anti")
    cold = mapped.where(F.col("n") <= total // HOT_PART).drop("n")
    return parts.join(hot, key).unionByName(rest.join(cold, key))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_entities, kinds, text) of every row, surrogates in place."""
    if not key:
        raise ValueError("surrogates need a key")
    own = ["id", "k1", "k2"]
    found = settle(entities(docs).dropDuplicates([*own, "pos"]))
    parts = found.select(
        *own, "pos", F.col("kind").alias("entity"), F.posexplode(parts_of(F.col("kind"), F.col("value"))).alias("sub", "part")
    ).select(*own, "pos", "entity", "sub", F.col("part.kind").alias("kind"), F.col("part.value").alias("value"))
    mapped = settle(assign(parts.select("kind", "value"), key))
    whole = (
        _joined(parts, mapped)
        .groupBy(*own, "pos", "entity")
        .agg(F.sort_array(F.collect_list(F.struct("sub", "surrogate", "kind", "value"))).alias("words"))  # the words of one name
        .select(*own, "pos", "entity", F.array_join(F.transform("words", lambda w: w["surrogate"]), " ").alias("new"), "words")
    )
    lists = whole.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("pos", "entity", "new", "words"))).alias("found"))
    lists = lists.select(*own, "found", _own_names(F.col("found")).alias("names")).withColumn(
        "found", F.transform("found", lambda x: F.struct(x["entity"].alias("entity"), x["new"].alias("new")))
    )
    k1, k2 = text_key(F.col("text"))
    rows = docs.select("doc_id", "text", id_key(F.col("doc_id")).alias("id"), k1.alias("k1"), k2.alias("k2"))
    joined = rows.join(lists, own, "left")
    named = F.coalesce(F.size("names"), F.lit(0)) > 0
    real = F.filter(F.transform("found", lambda x: x["entity"]), lambda x: x != "none")

    def shown(gap: Column) -> Column:
        text, n = _mentions(gap, F.col("names"))
        plain = F.struct(gap.alias("text"), F.lit(0).alias("n"))
        return F.when(named, F.struct(text.alias("text"), n.alias("n"))).otherwise(plain)

    gaps = F.when(F.col("found").isNotNull(), F.transform(F.split("text", ANY, -1), shown))
    woven = F.array_join(
        F.transform("gaps", lambda g, i: F.concat(g["text"], F.coalesce(F.get(F.col("found"), i)["new"], F.lit("")))), ""
    )
    bare = F.aggregate("gaps", F.lit(0), lambda n, g: n + g["n"])
    return joined.select("doc_id", "text", "found", gaps.alias("gaps")).select(
        "doc_id",
        (F.coalesce(F.size(real), F.lit(0)) + F.coalesce(bare, F.lit(0))).cast("long").alias("n_entities"),
        F.coalesce(
            F.array_join(F.array_sort(F.array_distinct(real)), ","), F.lit("")
        ).alias("kinds"),
        F.when(F.col("found").isNull(), F.col("text")).otherwise(woven).alias("text"),
    )


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, TRIAL_KEY)
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


QUERIES = {"op6_surrogates": op6_surrogates}
SQL: dict[str, str] = {}
