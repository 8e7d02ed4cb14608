"""Surrogates for personal data, in DataFrame functions only.

Detected are e-mail addresses, secrets behind a word such as ``token`` (quoted, or unquoted with a digit),
IPv4 and IPv6 addresses, IBANs, card and account numbers, telephone numbers (behind ``+``, behind a trunk
0, or in three groups) and names behind a title. Not detected: numbers of ten digits in one run, names
that stand behind no title in their document, postal addresses.

Coreference: mentions with one normal form have one surrogate in the whole table. It is the lower-case
address; the digits of a card; the last nine digits of a telephone number, so that the country code or a
trunk 0 may be missing; the secret itself; the family name, and the given name within its family, so that
``Mrs. Doe`` is of the family of ``Mrs. Jane Doe``. Later mentions of such names without a title, in the same document, are
replaced too.

A surrogate keeps type and format. Letters become keyed letters of the same script and case (a script
without an alphabet here becomes Latin, so no letter stays), digits become digits; top-level domains, the
country of an IBAN, a card's first digit and what precedes the last ten digits of a telephone number stay.
Cards satisfy Luhn's rule and IBANs their check digits. Given names come from lists by gender (of the
title, else of the name's ending) and script. Everything is drawn from SHA-512 of key, kind, attempt and
normal form.

Distinctness: of several entities with one surrogate the least keeps it, and no surrogate may be an
entity of the table; the others draw again until all have one. After ``WIDEN`` draws an address gets a
longer local part, a name another syllable or a second given name, and a secret more characters, ``MORE`` at most; numbers
never change their length. A space without any free number left ends the job with an error. Entities,
never texts, are shuffled for that. Each text is scanned once; only texts with entities are cut and joined.

Null and empty texts have no entities. Repeated rows get equal texts. Null ids don't matter. Very long
texts are scanned whole, in time linear in their length: no pattern can start twice in one run of
characters, and no group repeats without bound except possessively, which Java does in a loop. Empty tables
give no rows. The columns ``n_entities`` and ``kinds`` are replaced if they are there.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.plans.shared import drop_written, written
from typeloom.plans.skew import hot_keys, spread_join

KEY, WIDEN, MORE, PATIENCE = "typeloom surrogate key", 4, 6, 64
_L = r"\p{L}\p{M}\p{N}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TITLES = "Mr|Mrs|Ms|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora|Г-н|Г-жа"
_NAME = r"\p{Lu}[\p{Ll}\p{M}]++"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": rf"(?<![{_L}._%+-])[{_L}._%+-]++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)++",
    "secret": r"(?i:token|secret|password|passwd|api[_-]?key)[\"']?\s{0,4}[=:]\s{0,4}(?:[\"'][^\"'\n]{8,}+[\"']|(?=[A-Za-z+/_.=-]*+[0-9])[A-Za-z0-9+/_.=-]{8,}+)",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])|(?<![\p{{L}}\p{{N}}:.])(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?:[0-9A-Fa-f]{{1,4}}:){{2,6}}(?::[0-9A-Fa-f]{{1,4}}){{1,5}})(?![\p{{L}}\p{{N}}:])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"\+(?=[0-9])(?:[ .-]?\(?[0-9]\)?){8,15}(?![0-9])|(?<![0-9+])(?:(?=(?:[ /-]?[0-9]){9,13}(?![0-9]))0[1-9][0-9]{1,3}[ /-][0-9]{2,8}(?:[ -][0-9]{2,8}){0,3}|(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4})(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLES})\.? {_NAME}(?: {_NAME})?(?![\p{{L}}])",
}
ANY = "|".join(PATTERNS.values())
FEMALE, MALE = r"^(Mrs|Ms|Frau|Madame|Señora|Г-жа)", r"^(Mr|Herr|Monsieur|Señor|Г-н)\b"
FEMALE_ENDING = r"(a|e|ie|я|а)$"
#: Given names by gender and script.
NAMES = {
    ("f", "latin"): "Alice Beatrix Clara Dora Edith Flora Greta Helen Irene Julia Karen Laura Mona Nora Olga Paula Rita Sara Tilda Vera".split(),
    ("m", "latin"): "Adam Boris Carl David Edgar Felix Georg Hugo Ivan Jonas Karl Leo Marc Nils Oscar Paul Ralf Simon Theo Victor".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Жанна Зоя Инна Ксения Лидия Мария Нина Ольга Полина Раиса Софья Тамара".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
}
_range = lambda a, b: "".join(map(chr, range(a, b)))
#: (class of characters, what replaces them); the last that come are for scripts without an alphabet here.
ALPHABETS = [
    ("[0-9]", "0123456789"),
    ("[a-z]", _range(97, 123)),
    ("[A-Z]", _range(65, 91)),
    (r"[\p{IsLatin}&&\p{Lu}]", _range(0xC0, 0xD7) + _range(0xD8, 0xDF)),
    (r"\p{IsLatin}", _range(0xE0, 0xF7) + _range(0xF8, 0xFE)),
    (r"\p{IsGreek}", _range(0x3B1, 0x3C2) + _range(0x3C3, 0x3CA)),
    (r"\p{IsCyrillic}", _range(0x430, 0x450)),
    (r"\p{IsHan}", _range(0x4E00, 0x4F00)),
    (r"\p{IsHiragana}", _range(0x3042, 0x3094)),
    (r"\p{IsKatakana}", _range(0x30A2, 0x30F4)),
    (r"\p{IsHangul}", _range(0xAC00, 0xAD00)),
    (r"\p{IsArabic}&&\p{L}", _range(0x628, 0x63A)),
    (r"\p{IsHebrew}&&\p{L}", _range(0x5D0, 0x5EA)),
    (r"\p{IsDevanagari}&&\p{L}", _range(0x915, 0x939)),
    (r"\p{L}", _range(97, 123)),
    (r"\p{N}", "0123456789"),
]
SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу")}
_CYRILLIC = r"\p{IsCyrillic}"


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), 0)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not anew in each lambda that names it."""
    return F.get(F.transform(F.array(value), use), 0)


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind in reversed(list(PATTERNS)[:-1]):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _secret(entity: Column) -> tuple[Column, Column, Column]:
    """What precedes the secret, the secret, and what follows it."""
    head = F.regexp_extract(entity, r"^([^=:]*[=:]\s*[\"']?)", 1)
    tail = F.regexp_extract(entity, r"([\"']?)$", 1)
    return head, F.substr(entity, F.length(head) + 1, F.length(entity) - F.length(head) - F.length(tail)), tail


def parts_of(entity: Column, kind: Column) -> Column:
    """The entities (kind, normal, female) that a mention consists of: one, or a name's family and given names."""
    part = lambda k, n, f: F.struct(k.alias("kind"), n.alias("normal"), f.alias("female"))
    no, words = F.lit(False), F.slice(F.split(entity, " "), 2, 2)
    lower = F.transform(words, F.lower)
    family = F.element_at(lower, -1)
    female = entity.rlike(FEMALE) | (~entity.rlike(MALE) & lower[0].rlike(FEMALE_ENDING))
    names = F.array(part(F.lit("name"), family, no), part(F.lit("given"), F.array_join(lower, " "), female))
    digits = F.regexp_replace(entity, "[^0-9]", "")
    normal = F.when(kind == "phone", F.substr(digits, F.greatest(F.length(digits) - 8, F.lit(1)))).when(kind == "card", digits).when(kind == "iban", F.regexp_replace(entity, " ", "")).when(kind == "secret", _secret(entity)[1]).otherwise(F.lower(F.regexp_replace(entity, "^[._%+-]+", "")))
    return F.when(kind == "name", F.slice(names, F.lit(1), F.size(words))).otherwise(F.array(part(kind, normal, no)))


def _stream(kind: Column, normal: Column, attempt: int, key: str) -> Column:
    return F.sha2(F.concat_ws("\u001f", F.lit(key), kind, F.lit(str(attempt)), normal), 512)


def _number(stream: Column, at: int) -> Column:
    return F.conv(F.substr(stream, F.lit(at), F.lit(7)), 16, 10).cast("long")


def _shaped(normal: Column, stream: Column) -> Column:
    """Each letter or digit replaced by one of its kind; the stream's two hex digits for each place repeat, shifted, after 64."""
    places = F.transform(_chars(normal), lambda c, i: F.struct(c.alias("c"), (F.conv(F.substr(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 64).cast("int")).alias("v")))

    def one(p: Column) -> Column:
        out = p["c"]
        for chars, alphabet in reversed(ALPHABETS):
            pick = F.substr(F.lit(alphabet), p["v"] % len(alphabet) + 1, F.lit(1))
            out = F.when(p["c"].rlike(f"^[{chars}]$"), pick).otherwise(out)
        return out

    return F.array_join(F.transform(places, one), "")


def _luhn(digits: Column) -> Column:
    """``digits`` with the last one set by Luhn's rule."""
    n = F.length(digits)
    values = F.transform(_chars(digits), lambda c, i: F.when((n - i) % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    body = F.aggregate(F.slice(values, F.lit(1), n - 1), F.lit(0), lambda a, v: a + v)
    return F.concat(F.substr(digits, F.lit(1), n - 1), F.pmod(-body, F.lit(10)).cast("string"))


def _iban(normal: Column, shaped: Column) -> Column:
    """The country of ``normal``, check digits, and the account of ``shaped``."""
    country, account = F.substr(normal, F.lit(1), F.lit(2)), F.substr(shaped, F.lit(5))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(_chars(F.concat(account, country, F.lit("00"))), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (number % len(values) + 1).cast("int"))


def surrogate(kind: Column, normal: Column, female: Column, attempt: int, key: str = KEY) -> Column:
    """The candidate for a normal form at an attempt, itself in normal form."""
    more = min(max(attempt - WIDEN + 1, 0), MORE)
    return _bound(_stream(kind, normal, attempt, key), lambda stream: _drawn(kind, normal, female, stream, more))


def _drawn(kind: Column, normal: Column, female: Column, stream: Column, more: int) -> Column:
    shaped = _shaped(normal, stream)
    octets = F.concat_ws(".", *[(_number(stream, 7 * k + 1) % (223 if k == 0 else 254) + 1).cast("string") for k in range(4)])
    hexes = F.array_join(F.transform(_chars(normal), lambda c, i: F.when(c == ":", c).otherwise(F.substr(stream, i + 1, F.lit(1)))), "")
    wider = F.translate(F.substr(stream, F.lit(100), F.lit(more)), "0123456789", "ghijklmnop") if more else F.lit("")
    mail = F.concat(wider, F.regexp_extract(shaped, r"(?s)^(.*)\.[^.]*$", 1), F.lit("."), F.regexp_extract(normal, r"\.([^.]*)$", 1))
    word = {}
    for script, (consonants, vowels) in SYLLABLES.items():
        letters = [F.concat(_pick(list(consonants), _number(stream, 8 * k + 1)), _pick(list(vowels), _number(stream, 8 * k + 5))) for k in range(3 + more)]
        word[script] = F.concat(*letters, _pick(list(consonants), _number(stream, 8 * (3 + more) + 1)))
    given = {s: F.concat_ws("-", *[F.lower(F.when(female, _pick(NAMES["f", s], _number(stream, 9 * k + 1))).otherwise(_pick(NAMES["m", s], _number(stream, 9 * k + 1)))) for k in range(1 + more)]) for s in SYLLABLES}
    cyrillic = normal.rlike(_CYRILLIC)
    by_script = lambda x: F.when(cyrillic, x["cyrillic"]).otherwise(x["latin"])
    hex_secret = normal.rlike("^[0-9a-f]{1,128}$")
    secret = F.concat(F.when(hex_secret, F.substr(stream, F.lit(1), F.length(normal))).otherwise(shaped), F.substr(stream, F.lit(100), F.lit(more)) if more else F.lit(""))
    return (
        F.when(kind == "email", mail)
        .when(kind == "secret", secret)
        .when(kind == "ip", F.when(normal.contains(":"), hexes).otherwise(octets))
        .when(kind == "iban", _iban(normal, shaped))
        .when(kind == "card", _luhn(F.concat(F.substr(normal, F.lit(1), F.lit(1)), F.substr(shaped, F.lit(2)))))
        .when(kind == "name", by_script(word))
        .when(kind == "given", F.concat(by_script(given), F.lit(" "), F.element_at(F.split(normal, " "), -1)))
        .otherwise(shaped)
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, normal, surrogate): one surrogate for each distinct entity of (kind, normal, female), none twice and none real."""
    real = written(entities.groupBy("kind", "normal").agg(F.max("female").alias("female")), "entities")
    taken = real.select("kind", F.col("normal").alias("surrogate"))
    done, left, attempt, idle, before = None, real, 0, 0, None
    while True:
        drawn = left.withColumn("surrogate", surrogate(F.col("kind"), F.col("normal"), F.col("female"), attempt, key))
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        won = written(free.groupBy("kind", "surrogate").agg(F.min("normal").alias("normal")).select("kind", "normal", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        taken = taken.unionByName(won.select("kind", "surrogate"))
        left = written(left.join(won, ["kind", "normal"], "left_anti"), "undecided")
        n = left.count()
        if not n:
            return done
        attempt, idle = attempt + 1, idle + 1 if n == before else 0
        if idle >= PATIENCE:
            raise RuntimeError(f"no free surrogate is left for {n} entities, among them {left.first()}")
        before = n


def _formatted(entity: Column, new: Column, chars: str) -> Column:
    """The characters of ``new``, one after another, in the places of ``entity`` that are among ``chars``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(acc: Column, c: Column) -> Column:
        fits = c.rlike(f"[{chars}]")
        return F.struct(F.concat(acc["out"], F.when(fits, F.substr(new, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + F.when(fits, 1).otherwise(0)).alias("at"))

    return F.aggregate(_chars(entity), start, put, lambda acc: acc["out"])


def _cased(entity: Column, new: Column) -> Column:
    """``new`` with the upper case of ``entity``, place by place from the end; both in full if lower case has another length."""
    more = F.greatest(F.length(new) - F.length(entity), F.lit(0))
    upper = F.zip_with(_chars(entity), _chars(F.substr(new, more + 1)), lambda e, n: F.when((e != F.lower(e)) & (F.length(F.upper(n)) == 1), F.upper(n)).otherwise(n))
    return F.when(F.length(F.lower(entity)) == F.length(entity), F.concat(F.substr(new, F.lit(1), more), F.array_join(upper, ""))).otherwise(new)


def _capitalised(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "-"), F.initcap), "-")


def render(entity: Column, kind: Column, new: Column, key: str = KEY) -> Column:
    """The surrogates ``new`` (an array, as :func:`parts_of`) in the mention's format."""
    first = new[0]
    digits = F.regexp_replace(entity, "[^0-9]", "")
    n = F.length(digits)
    tenth = F.conv(F.substr(F.sha2(F.concat(F.lit(key), first), 256), F.lit(1), F.lit(4)), 16, 10).cast("int") % 9 + 1
    phone = F.concat(F.substr(digits, F.lit(1), F.greatest(n - 10, F.lit(0))), F.when(n >= 10, tenth.cast("string")).otherwise(""), first)
    head, _, tail = _secret(entity)
    lead = F.regexp_extract(entity, "^([._%+-]*)", 1)
    names = F.concat(F.regexp_extract(entity, r"^(\S+ )", 1), F.when(F.size(new) > 1, F.concat(_capitalised(F.split(new[1], " ")[0]), F.lit(" "))).otherwise(""), F.initcap(first))
    return (
        F.when(kind == "phone", _formatted(entity, phone, "0-9"))
        .when(kind == "card", _formatted(entity, first, "0-9"))
        .when(kind == "iban", _formatted(entity, first, "0-9A-Z"))
        .when(kind == "secret", F.concat(head, first, tail))
        .when(kind == "name", names)
        .when(kind == "ip", first)
        .otherwise(F.concat(lead, _cased(F.substr(entity, F.length(lead) + 1), first)))
    )


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in the text, and the columns n_entities and kinds (distinct, sorted)."""
    names = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ANY), 0)
    scanned = written(docs.select(*names, found.alias("__found"), F.monotonically_increasing_id().alias("__row")), "scanned")
    clean = scanned.where(F.size("__found") == 0).select(*names, F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    some = scanned.where(F.size("__found") > 0)
    each = some.select("__row", F.posexplode("__found").alias("pos", "entity"))
    one = F.col("entity")
    typed = each.groupBy("entity").agg(F.count("*").alias("n")).select("entity", "n", kind_of(one).alias("kind"))
    typed = written(typed.withColumn("parts", parts_of(one, F.col("kind"))), "mentions")
    parts = typed.select("entity", F.posexplode("parts").alias("at", "part")).select("entity", "at", "part.*")
    own = surrogates(parts.select("kind", "normal", "female"), key)
    new = parts.join(own, ["kind", "normal"]).groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("new"))
    table = typed.join(new, "entity").select("entity", "kind", render(one, F.col("kind"), F.col("new"), key).alias("new"))
    table = written(table, "renderings")
    put = spread_join(each, table, ["entity"], hot_keys(typed, ["entity"]), ["__row", "pos"])
    put = put.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("pos", "entity", "new", "kind"))).alias("__new"))
    titled = F.filter("__new", lambda x: x["kind"] == "name")
    words = lambda c: F.flatten(F.transform(titled, lambda x: F.slice(F.split(x[c], " "), 2, 2)))
    swaps = F.array_distinct(F.arrays_zip(words("entity").alias("old"), words("new").alias("new")))
    # a word may be a given and a family name: the first of its surrogates is taken
    joined = some.join(put, "__row").withColumn("__swaps", F.map_from_entries(F.aggregate(swaps, F.expr("cast(array() as array<struct<old:string,new:string>>)"), lambda acc, x: F.when(F.exists(acc, lambda y: y["old"] == x["old"]), acc).otherwise(F.concat(acc, F.array(x))))))
    renamed = lambda gap: F.array_join(F.transform(F.regexp_extract_all(gap, F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), 0), lambda w: F.coalesce(F.try_element_at("__swaps", w), w)), "")
    gaps = F.split("text", ANY, -1)
    gaps = F.when(F.size("__swaps") > 0, F.transform(gaps, renamed)).otherwise(gaps)
    pieces = F.zip_with(gaps, "__new", lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b["new"], F.lit(""))))
    kinds = F.array_sort(F.array_distinct(F.transform("__new", lambda x: x["kind"])))
    swapped = joined.withColumn("text", F.array_join(pieces, ""))
    drop_written(typed)
    return clean.unionByName(swapped.select(*names, F.size("__new").alias("n_entities"), kinds.alias("kinds")))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
