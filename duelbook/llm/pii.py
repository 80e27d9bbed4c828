"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Detected: e-mail addresses, phone numbers (international, or with an area code set off), payment cards (with a right check
digit), IBANs (likewise), numbers like 123-45-6789, IPv4 and IPv6 addresses, and names: a title or a known given name before
capitalised words.

What fails its check uses up no text: cards and IBANs are looked for at every place where one may begin, others resume behind that place,
and of overlapping ones the first stays. IBANs have their country's length, phone numbers 8 to 15 digits; a short number right behind
a phone number cannot be told from its last digits and counts as them.

An entity is a kind and a canonical value (lower case, or the digits alone), so every way of writing it is one entity and gets
one surrogate in all documents, written in the format of each mention. The surrogate comes from a hash of the key, the kind, the value
and a number of attempt: letters become letters of the same script and case, digits digits, check digits are right
again, a name gets a given name of the same gender and script. Equal domains and surnames stay equal.

Collisions are looked up: no two entities of a kind share a surrogate, and none is another entity's real value. Losers try the next
attempt, until all entities have one. From attempt WIDEN on each attempt draws from a larger space: surnames get further syllables,
e-mail names more characters, private IPv4 addresses leave their network, IPv6 addresses are written in full, phone numbers (up to 15
digits) and numbers like 123-45-6789 get longer. Cards and IBANs keep their length, which leaves 10^11 values or more. All tables grow with the mentions and are joined by shuffles; texts without mentions
are not shuffled.

Null texts stay null, texts without mentions stay as they are. Repeated texts get the same result. An input column named
n_pii is replaced; columns named _key, _found and _parts are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelbook.llm.batches import without
from duelbook.session import cut

ATTEMPTS = 64
#: The attempt from which the spaces of surrogates grow.
WIDEN = 4

# Titles, given names by script and gender, syllables and letters by script.
MALE_TITLES = ("Mr", "Herr", "Señor", "Monsieur", "господин", "κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mademoiselle", "госпожа", "κυρία")
OTHER_TITLES = ("Dr", "Prof", "Professor")
GIVEN = {
    ("latin", "m"): ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Klaus", "Jürgen", "Wolfgang", "Carlos",
                     "José", "Miguel", "Javier", "Pierre", "François", "Philippe", "Nicolas"),
    ("latin", "f"): ("Mary", "Patricia", "Jennifer", "Elizabeth", "Linda", "Sarah", "Susan", "Emily", "Ursula", "Sabine", "Monika", "Heike", "Carmen",
                     "María", "Lucía", "Isabel", "Camille", "Brigitte", "Sylvie", "Margaux"),
    ("cyrillic", "m"): ("Иван", "Дмитрий", "Сергей", "Алексей", "Николай", "Владимир", "Михаил", "Андрей"),
    ("cyrillic", "f"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Παναγιώτης", "Χρήστος"),
    ("greek", "f"): ("Μαρία", "Ελένη", "Κατερίνα", "Βασιλική", "Σοφία", "Αγγελική"),
}
SYLLABLES = {
    "latin": "bar bel dor fen gal han jor kel lan mar nor pel ran sol tam vel wes yar zin der ter man son ley ton".split(),
    "cyrillic": "бар вел дор зин кал лем мар нор пел рин сол там фед чер шел ков лин дов".split(),
    "greek": "βαρ γαλ δελ ζιν θελ καλ λαμ μαρ νικ παν ρουν σολ ταμ φιλ χαρ".split(),
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
HAN = "安白川东方高国海和华江金林明南平青山石天文西新阳玉云中"

_CAP = r"\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+){0,8}"
_TITLE = "(?:" + "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES) + r")\.?\x20+"
_NAMES = "(?:" + "|".join(n for v in GIVEN.values() for n in v) + ")"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Characters after the check digits of an IBAN by country.
IBAN_SIZES = {
    11: "NO", 12: "BE", 14: "DK FI FK FO GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK", 17: "CH CR HR LI LV",
    18: "BG BH DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "LY PT ST", 22: "IS TR",
    23: "BI DJ FR GR IT MC MR SM", 24: "AL AZ BY CY DO GT HN HU LB NI PL SV YE", 25: "BR EG PS QA UA", 26: "JO KW MU", 27: "MT SC", 29: "LC RU",
}
_IBAN = "|".join(rf"(?:{codes.replace(' ', '|')})\d{{2}}(?:\x20?[A-Z0-9]{{4}}){{{n // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, codes in IBAN_SIZES.items())
_OTHER = f"(?!{'|'.join(IBAN_SIZES.values()).replace(' ', '|')})"
#: No card begins here; one behind a country code and another number has more digits than a phone number.
_NO_CARD = r"(?![\x20-]\d{4}(?:[\x20-]\d{4}){3}(?!\d)|[\x20-]\d{4}[\x20-]\d{6}[\x20-]\d{5}(?!\d))"
_DIGIT = r"\d[\x20./()-]{0,3}"
PATTERNS = {
    "email": r"[\p{L}\p{N}_][\p{L}\p{N}._%+-]*+@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.){1,127}\p{L}{2,}",
    "ipv4": rf"(?<!\d\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "ipv6": r"(?<!:)(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<!:)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,5}(?![0-9A-Fa-f:])",
    "iban": rf"(?=[A-Z]{{2}}\d{{2}})(?:{_IBAN}|{_OTHER}[A-Z]{{2}}\d{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"\d{13,19}(?!\d)|\d{4}(?:-\d{4}){2}-\d{1,7}(?!\d)|\d{4}(?:\x20\d{4}){2}\x20\d{1,7}(?!\d)|\d{4}[\x20-]\d{6}[\x20-]\d{5}(?!\d)",
    "phone": rf"\+\d{{1,3}}(?:{_NO_CARD}[\x20./-]?\(?\d{{1,5}}\)?){{2,5}}(?!\d)(?<={_DIGIT * 8})(?<!{_DIGIT * 16})|" r"\(\d{3}\)[\x20-]?\d{3}[\x20.-]\d{4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "name": rf"{_TITLE}{_CAP}(?:\x20{_CAP}){{0,2}}|{_NAMES}(?:\x20{_CAP}){{1,2}}",
}
#: Kinds whose check can fail: matched without using up text, in the first group.
CHECKED = ("iban", "card")
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(
    [f"(?:{PATTERNS[k]})" for k in ("email", "ipv4", "ipv6")] + [f"(?=({'|'.join(f'(?:{PATTERNS[k]})' for k in CHECKED)}))"]
    + [f"(?:{PATTERNS[k]})" for k in ("ssn", "phone", "name")]) + ")"


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _luhn_sum(digits: Column) -> Column:
    """The weighted sum; every second digit from the right, the last but one first, is doubled."""
    places = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """Remainder of a string of digits and capital letters, which count as 10 to 35."""
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _kind(raw: Column) -> Column:
    """The kind whose whole pattern the mention is and whose check it passes, else null."""
    digits = F.regexp_replace(raw, r"\D", "")
    plain = F.replace(raw, F.lit(" "), F.lit(""))
    checks = {
        "card": (_luhn_sum(digits) % 10 == 0) & ~F.regexp_like(digits, F.lit(r"^(\d)\1*$")),
        "iban": _mod97(F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))) == 1,
        "phone": F.length(digits).between(8, 15),
    }
    out = None
    for kind, pattern in PATTERNS.items():
        is_it = F.regexp_like(raw, F.lit(f"^(?:{pattern})$"))
        if kind in checks:
            is_it = is_it & checks[kind]
        out = F.when(is_it, kind) if out is None else out.when(is_it, kind)
    return out


def _canon(kind: Column, raw: Column) -> Column:
    return (F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(raw, r"[^\d+]", ""))
            .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
            .when(kind == "name", F.lower(F.regexp_replace(raw, f"^{_TITLE}", "")))
            .otherwise(F.lower(raw)))


def _gender(raw: Column) -> Column:
    """m or f by title, else by given name; null if neither tells."""
    out = F.when(F.regexp_like(raw, F.lit(rf"^(?:{'|'.join(MALE_TITLES)})\.?\x20")), "m").when(
        F.regexp_like(raw, F.lit(rf"^(?:{'|'.join(FEMALE_TITLES)})\.?\x20")), "f")
    for (_, gender), names in GIVEN.items():
        out = out.when(F.regexp_like(raw, F.lit(rf"^(?:{_TITLE})?(?:{'|'.join(names)})(?:\x20|$)")), gender)
    return out


def _digest(key: str, *parts: Column) -> Column:
    """256 hex digits; a value has four of them for each place, from the 65th place again the first."""
    text = F.concat_ws("\u0001", F.lit(key), *[p.cast("string") for p in parts])
    return F.concat(F.sha2(F.concat(text, F.lit("\u00010")), 512), F.sha2(F.concat(text, F.lit("\u00011")), 512))


def _number(digest: Column, place) -> Column:
    return F.conv(F.substring(digest, (place % 64) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(choices, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), number % len(choices) + 1)


def _script(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.regexp_like(text, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def _shaped(text: Column, digest: Column) -> Column:
    """Each letter becomes one of its script and case, each digit a digit, all else stays. Scripts without an alphabet here become Latin."""
    def other(c, i):
        n = _number(digest, i)
        letter = (F.when(F.regexp_like(c, F.lit(r"\p{IsCyrillic}")), _pick(ALPHABETS["cyrillic"], n))
                  .when(F.regexp_like(c, F.lit(r"\p{IsGreek}")), _pick(ALPHABETS["greek"], n))
                  .when(F.regexp_like(c, F.lit(r"\p{IsHan}")), _pick(HAN, n)).otherwise(_pick(ALPHABETS["latin"], n)))
        return (F.when(F.regexp_like(c, F.lit(r"\p{N}")), (n % 10).cast("string"))
                .when(F.regexp_like(c, F.lit(r"\p{Lu}")), F.upper(letter)).when(F.regexp_like(c, F.lit(r"\p{L}")), letter).otherwise(c))

    return F.array_join(F.transform(_chars(text), other), "")


def _surname(word: Column, digest: Column, size: int) -> Column:
    """A surname of so many syllables."""
    made = None
    for script, syllables in SYLLABLES.items():
        value = F.concat(*[_pick(syllables, _number(digest, F.lit(k))) for k in range(size)])
        is_it = _script(word) == script
        made = F.when(is_it, value) if made is None else made.when(is_it, value)
    return F.initcap(made)


def _name(canon: Column, gender: Column, attempt: int, key: str) -> Column:
    words = F.split(canon, " ")
    whole = _digest(key, F.lit("name"), F.lit(attempt), canon)
    known = F.coalesce(gender, F.when(_number(whole, F.lit(9)) % 2 == 0, "m").otherwise("f"))
    given = None
    for (script, g), names in GIVEN.items():
        is_it = (_script(canon) == script) & (known == g)
        value = _pick(names, _number(whole, F.lit(8)))
        given = F.when(is_it, value) if given is None else given.when(is_it, value)
    # a surname alone decides the first attempt, so relatives keep one name
    rest = F.transform(F.when(F.size(words) > 1, F.slice(words, 2, 9)).otherwise(words), lambda w: _surname(
        w, _digest(key, F.lit("surname"), F.concat(canon, F.lit(str(attempt)), w) if attempt else w), 3 + max(0, attempt - WIDEN + 1)))
    return F.when(F.size(words) > 1, F.concat(given, F.lit(" "), F.array_join(rest, " "))).otherwise(F.array_join(rest, " "))


def _surrogate(kind: Column, canon: Column, gender: Column, attempt: int, key: str) -> Column:
    digest = _digest(key, kind, F.lit(attempt), canon)
    shaped = _shaped(canon, digest)
    wider = max(0, attempt - WIDEN + 1)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    stem, top = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1), F.substring_index(domain, ".", -1)
    longer = F.substring(digest, 200, min(56, 5 + wider)) if wider else F.lit("")
    email = F.concat(_shaped(local, digest), longer, F.lit("@"), _shaped(stem, _digest(key, F.lit("domain"), domain)), F.lit("."), top)
    octets = [(_number(digest, F.lit(k)) % 254 + 1).cast("string") for k in range(4)]
    # a full private network goes over into the next larger one, then into all addresses
    ten, any_ = F.concat_ws(".", F.lit("10"), *octets[1:]), F.concat_ws(".", *octets)
    ipv4 = (F.when(F.startswith(canon, F.lit("10.")), any_ if wider > WIDEN else ten)
            .when(F.startswith(canon, F.lit("192.168.")), any_ if wider > WIDEN else ten if wider else F.concat_ws(".", F.lit("192.168"), *octets[2:]))
            .otherwise(any_))
    ipv6 = F.regexp_replace(F.substring(digest, 1, 32), "(.{4})(?=.)", "$1:") if wider else F.array_join(F.transform(_chars(canon), lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex(_number(digest, i) % 16)))), "")
    body = F.concat(F.substring(canon, 1, 1), F.substring(shaped, F.lit(2), F.length(canon) - 2))
    card = F.concat(body, ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    country, account = F.substring(canon, 1, 2), F.substring(shaped, 5, 100)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    phone = F.when(F.startswith(canon, F.lit("+")), F.concat(F.substring(canon, 1, 2), F.substring(shaped, 3, 100))).otherwise(shaped)
    ssn = shaped
    if wider:
        digits = F.translate(F.substring(digest, 200, min(56, wider)), "abcdef", "012345")
        phone = F.concat(phone, F.substring(digits, F.lit(1), F.greatest(F.lit(0), 15 - F.length(F.regexp_replace(canon, r"\D", "")))))
        ssn = F.concat(ssn, digits)
    return (F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind == "ipv6", ipv6).when(kind == "card", card).when(kind == "iban", iban)
            .when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "name", _name(canon, gender, attempt, key)).otherwise(shaped))


def _written(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the format of a mention; what is longer than it follows."""
    signs = F.regexp_replace(surrogate, r"\+", "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    filled = F.aggregate(_chars(raw), start, lambda a, c: F.when(
        F.regexp_like(c, F.lit("[A-Za-z0-9]")), F.struct(F.concat(a["out"], F.substring(signs, a["at"] + 1, F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
        lambda a: F.concat(a["out"], F.substring(signs, a["at"] + 1, F.length(signs))))
    title = F.regexp_extract(raw, f"^{_TITLE}", 0)
    shout = F.when(raw == F.upper(raw), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), filled).when(kind == "name", F.concat(title, surrogate)).otherwise(shout)


def _gaps(split: Column, matches: Column) -> Column:
    """The texts before, between and behind the matches; where an empty match begins the text, ``split`` leaves out the first."""
    return F.when(F.size(split) > matches, split).otherwise(F.concat(F.array(F.lit("")), split))


def mentions(documents: DataFrame, text: str = "text") -> DataFrame:
    """(_key, place, raw, kind, canon, gender, used, cut, skip) of every match in the distinct texts.

    The key is a hash of the text. The kind is null for what a check or an earlier match rules out. ``used`` is the text that the pattern
    used up, ``cut`` and ``skip`` how many code points of it, and of the text up to the next match, earlier and own mentions cover.
    """
    hit = documents.where(F.regexp_like(F.col(text), F.lit(PATTERN))).select(F.sha2(text, 256).alias("_key"), F.col(text).alias("x"))
    used, ahead = (F.regexp_extract_all(F.col("x"), F.lit(PATTERN), F.lit(k)) for k in (0, 1))
    hit = hit.select("_key", F.split("x", PATTERN, -1).alias("split"), used.alias("used"), ahead.alias("ahead"))
    lengths = F.transform(_gaps(F.col("split"), F.size("used")), lambda g: F.length(g).cast("long"))
    rows = hit.select("_key", F.posexplode(F.arrays_zip(lengths.alias("gap"), F.col("used"), F.col("ahead"))).alias("place", "m"))
    once = rows.where("m.used is not null").groupBy("_key", "place").agg(F.first(F.struct(
        "m.gap", "m.used", F.coalesce(F.nullif("m.ahead", F.lit("")), F.col("m.used")).alias("raw"))).alias("m"))
    order = Window.partitionBy("_key").orderBy("place")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = once.select("_key", "place", "m.used", "m.raw", "m.gap").withColumn("kind", _kind(F.col("raw"))).withColumn(
        "behind", F.sum(F.col("gap") + F.length("used")).over(upto)).withColumn("start", F.col("behind") - F.length("used"))
    placed = placed.withColumn("end", F.when(F.col("kind").isNotNull(), F.col("start") + F.length("raw")))
    # mentions that overlap, directly or by others, are a group; in it the first stays, and the first behind it, and so on
    apart = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))
    grouped = placed.withColumn("apart", apart).withColumn("group", F.sum(F.col("apart").cast("int")).over(upto))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<int>").alias("places"))
    runs = F.sort_array(F.collect_list(F.when(F.col("end").isNotNull(), F.struct("place", "start", "end"))).over(Window.partitionBy("_key", "group")))
    kept = F.aggregate(F.col("runs"), start, lambda a, m: F.when(m["start"] >= a["end"], F.struct(
        m["end"].alias("end"), F.concat(a["places"], F.array(m["place"])).alias("places"))).otherwise(a), lambda a: a["places"])
    chosen = grouped.withColumn("runs", runs).withColumn("stays", F.when(F.size("runs") > 1, F.array_contains(kept, F.col("place"))).otherwise(F.lit(True)))
    chosen = chosen.withColumn("kind", F.when(F.col("stays"), F.col("kind"))).withColumn("end", F.when(F.col("kind").isNotNull(), F.col("end")))
    none = F.lit(0).cast("long")
    told = chosen.withColumns({
        "cut": F.greatest(none, F.coalesce(F.max("end").over(before) - F.col("start"), none)),
        "skip": F.greatest(none, F.coalesce(F.max("end").over(upto) - F.col("behind"), none))})
    return told.select(
        "_key", "place", "raw", "kind", _canon(F.col("kind"), F.col("raw")).alias("canon"), F.when(F.col("kind") == "name", _gender(F.col("raw"))).alias("gender"),
        "used", "cut", "skip")


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for every entity: distinct in each kind, and no entity's own value."""
    entities = cut(found.where("kind is not null").groupBy("kind", "canon").agg(F.max("gender").alias("gender")))
    real = entities.select("kind", F.col("canon").alias("lower"))
    pending, settled = entities, None
    for attempt in range(ATTEMPTS):
        tried = pending.withColumn("surrogate", _surrogate(F.col("kind"), F.col("canon"), F.col("gender"), attempt, key)).withColumn("lower", F.lower("surrogate"))
        first = F.row_number().over(Window.partitionBy("kind", "lower").orderBy("canon"))
        tried = cut(tried.withColumn("place", first))
        free = tried.where("place = 1").join(real, ["kind", "lower"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "lower"), ["kind", "lower"], "left_anti")
        free = cut(free.select("kind", "canon", "surrogate", "lower"))
        settled = free if settled is None else settled.union(free)
        pending = cut(pending.join(free, ["kind", "canon"], "left_anti"))
        if pending.isEmpty():
            return settled.select("kind", "canon", "surrogate")
    raise RuntimeError(f"entities without a free surrogate after {ATTEMPTS} attempts")


def pseudonymise(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with surrogates in place of personal data, and ``n_pii``, the mentions replaced."""
    source = without(documents, ["n_pii", "_key", "_found", "_parts"])
    found = cut(mentions(source, text))
    named = found.join(surrogates(found, key), ["kind", "canon"], "left")
    old = F.substring(F.col("used"), F.col("cut").cast("int") + 1, F.length("used"))
    parts = named.withColumn("new", F.coalesce(_written(F.col("kind"), F.col("raw"), F.col("surrogate")), old)).groupBy("_key").agg(
        F.sort_array(F.collect_list(F.struct("place", "new", F.col("skip").cast("int").alias("skip")))).alias("_found"), F.count("surrogate").alias("n_pii"))
    has = F.coalesce(F.regexp_like(F.col(text), F.lit(PATTERN)), F.lit(False))
    hit = source.where(has).withColumn("_key", F.sha2(text, 256)).join(parts, "_key")
    hit = hit.withColumn("_parts", F.split(F.col(text), PATTERN, -1))
    gaps = _gaps(F.col("_parts"), F.size("_found"))
    pieces = F.zip_with(F.col("_found"), F.slice(gaps, 2, F.size("_found")), lambda m, gap: F.concat(
        m["new"], F.when(m["skip"] > 0, F.substring(gap, m["skip"] + 1, F.length(gap))).otherwise(gap)))
    replaced = hit.withColumn(text, F.concat(F.element_at(gaps, 1), F.array_join(pieces, ""))).select(*[F.col(f"`{c}`") for c in source.columns], "n_pii")
    return source.where(~has).withColumn("n_pii", F.lit(0).cast("long")).unionByName(replaced)
