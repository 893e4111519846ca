"""Personal data replaced by surrogates; DataFrame functions only.

Entities are found by patterns and named by kind. Numbers that only look like one are left alone: a card's and an IBAN's check digits must
hold, an address's numbers must be at most 255 and stand behind no word for a version. Names are found behind titles; a document that
names a person so has its other mentions of the full name and of the family name found too, also in capitals, and the full name in small letters.

A surrogate is made from a keyed SHA-256 stream of (key, kind, normal form, attempt): letters become letters of the same case
and script, digits digits (hexadecimal ones in values that are hexadecimal as a whole), separators stay, so that a value keeps its format. Tokens keep the
prefix that tells their kind, card numbers and IBANs get valid check digits, private and local network addresses keep what makes them that and public ones stay
public, telephone numbers keep their country code and are one with it and without, mail addresses keep their top-level domain. Mail addresses and names are made of parts that are each replaced
alike wherever they stand: an address's domain, a person's given and family name. So "Mr. John Smith", "Dr. John Smith", "Mr. Smith"
and "John Smith" stay one person, and addresses of one domain stay together. Titles stay; a given name gets a name of its gender, which most of the
titles that it has in all documents decide, and of its script. The normal form leaves out case and separators: all spellings of
a value get one surrogate each in its own spelling, in all documents.

Collision checks: over the distinct values of all documents, two values of a kind must not share a surrogate and a
surrogate must not be another real value of the corpus, in no spelling. Values that break this get the next attempt, until none
does; names, mail addresses and domains get longer by every GROWS attempts, as short ones run out. If MOST_TRIES don't do, that is an error.

Defined results: null texts stay null and hold nothing; rows that repeat a doc_id, or have none, are rewritten one by one; an
empty table gives an empty table; columns of docs named as the added ones are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, hinted, kept_columns, row_key, settled

_TITLES = "Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora|Господин|Госпожа"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_TOKEN_HEADS = r"AKIA|(?:ghp|gho|sk|pk|xoxb)[_\-]"
_CODE = r"^(\+1(?=[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}$)[ .\-]?|\+[0-9]{1,3}[ .\-]?|)"
_GROUP6 = "[0-9A-Fa-f]{1,4}"
#: Fixed patterns by kind, tried in this order.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
    "token": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|(?:ghp|gho|sk|pk|xoxb)[_\-][0-9A-Za-z_\-]{16,})(?![0-9A-Za-z])",
    "ip": rf"(?<![\p{{L}}0-9.])(?<!(?i:version|release|build|section|chapter)[ .:]{{1,2}})(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:{_GROUP6}:){{7}}{_GROUP6}(?![0-9A-Za-z:.])|(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:{_GROUP6}:){{1,6}}(?::{_GROUP6}){{1,5}}(?![0-9A-Za-z:.])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])(?:[0-9][ \-]?){12,18}[0-9](?![0-9])",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'\-]+(?: \p{{Lu}}[\p{{L}}'\-]+)?",
}
_ANY = "|".join(KINDS.values())
#: Found in every text that _ANY is found in.
_CHEAP = rf"@|[0-9A-Fa-f]::?[0-9A-Fa-f]|[0-9][ .)\-]{{0,2}}[0-9]|[a-f]{{32}}|[A-F]{{32}}|AKIA[A-Z]{{16}}|(?:ghp|gho|sk|pk|xoxb)[_\-][0-9A-Za-z_\-]{{16}}|(?:{_TITLES})\.? \p{{Lu}}"
#: Given names by gender and script, and syllables of family names.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul".split(),
    ("f", "latin"): "Alma Berta Clara Dora Elena Frida Greta Helga Irma Julia Klara Lena Maria Nora Olga Paula".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур".split(),
    ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лариса Мария Нина Ольга Полина Раиса Софья".split(),
}
SYLLABLES = {"latin": "ba den fer gol hal kem lin mor nas pel ros sten tal ver wil zan".split(), "cyrillic": "ба вен гор дам зел кар лин мор нов пел рас сев тал фед хол чер".split()}
#: Letters of other scripts and of Latin with marks, by the pattern of the letter that they replace.
LETTERS = {"[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[\p{IsCyrillic}&&\p{Ll}]": "абвгдежзиклмнопрстуфхц", r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦ", r"[\p{IsGreek}&&\p{Ll}]": "αβγδεζηθικλμνξοπρστυφχψω", r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"[\p{IsLatin}&&\p{Ll}]": "àáâãèéêìíîòóôõùúû", r"[\p{IsLatin}&&\p{Lu}]": "ÀÁÂÃÈÉÊÌÍÎÒÓÔÕÙÚÛ"}

#: A surrogate of a name, mail address or domain gets one more syllable or letter after so many attempts; so many attempts a value at most.
GROWS, MOST_TRIES = 1, 200


def normal(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]+", ""))


def kind_of(value: Column) -> Column:
    """The kind of what was found; null for a card number or IBAN whose check digits don't hold. What no pattern has is a name without a title."""
    out = None
    for kind, pattern in KINDS.items():
        match = value.rlike(f"^(?:{pattern})$")
        name = F.when(_luhn(_digits(value)) % 10 == 0, kind) if kind == "card" else F.when(_mod97(value) == 1, kind) if kind == "iban" else F.lit(kind)
        out = F.when(match, name) if out is None else out.when(match, name)
    return out.otherwise("name")


def _title(name: Column) -> Column:
    return F.regexp_extract(name, rf"^((?:{_TITLES})\.? )", 1)


def _given(name: Column) -> Column:
    """The given name, empty if there is the family name alone."""
    rest = F.substr(name, F.length(_title(name)) + 1)
    return F.when(F.contains(rest, F.lit(" ")), F.substring_index(rest, " ", 1)).otherwise("")


def _family(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def _domain(mail: Column) -> Column:
    return F.substring_index(mail, "@", -1)


def parts(e: Column) -> Column:
    """What of an entity is replaced by itself: arrays of (kind, value)."""
    part = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    mail = F.array(part(F.lit("email"), e["value"]), part(F.lit("domain"), _domain(e["value"])))
    name = F.filter(F.array(part(F.lit("given"), _given(e["value"])), part(F.lit("family"), _family(e["value"]))), lambda x: x["value"] != "")
    return F.when(e["kind"] == "email", mail).when(e["kind"] == "name", name).otherwise(F.array(part(e["kind"], e["value"])))


def identity(kind: Column, value: Column) -> Column:
    """The normal form of a part, in which it must differ from others of its kind; a mail address's halves stay apart, a telephone number is one with country code 1 and without."""
    mail = F.concat(normal(F.substring_index(value, "@", 1)), F.lit("@"), normal(_domain(value)))
    national = F.regexp_replace(normal(value), "^1(?=[0-9]{10}$)", "")
    return F.when(kind == "email", mail).when(kind == "phone", national).when(kind == "ipv6", F.lower(value)).otherwise(normal(value))


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """256 hexadecimal digits that stand for 128 numbers of 0 to 255."""
    seed = F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{block}")).cast("binary"), 256) for block in range(4)])


def _number(stream: Column, at: Column) -> Column:
    return F.conv(F.substr(stream, (at % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _one_of(values: str | list[str], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), number % len(values))


def _hexadecimal(value: Column, kind: Column) -> Column:
    """Of a token that is one number, or an address of groups, the case of its hexadecimal digits; empty for others."""
    whole = F.when(value.rlike("^[0-9a-f:]+$"), "lower").when(value.rlike("^[0-9A-F:]+$"), "upper").when(kind == "ipv6", "lower").otherwise("")
    return F.when(kind.isin("token", "ipv6"), whole).otherwise("")


def _woven(value: Column, stream: Column, digits: Column) -> Column:
    """value with each letter and digit replaced, by its place among them; digits: the case of hexadecimal ones, if they are."""

    def step(state: Column, c: Column) -> Column:
        n = _number(stream, state["j"])
        new = F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
        for pattern, letters in LETTERS.items():
            new = new.when(c.rlike(pattern), _one_of(letters, n))
        new = F.when((digits == "lower") & c.rlike("[0-9a-f]"), _one_of("0123456789abcdef", n)).when((digits == "upper") & c.rlike("[0-9A-F]"), _one_of("0123456789ABCDEF", n)).otherwise(new.otherwise(c))
        counts = c.rlike(r"[\p{L}\p{N}]").cast("int")
        return F.struct(F.concat(state["out"], new).alias("out"), (state["j"] + counts).alias("j"))

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("j")), step)["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The sum that a valid card number has divisible by 10."""
    one = lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), one), F.lit(0), lambda a, x: a + x)


def _card(woven: Column) -> Column:
    """woven with the check digit that makes it valid."""
    body = F.substr(woven, F.lit(1), F.length(woven) - 1)
    last = (10 - _luhn(F.concat(_digits(body), F.lit("0"))) % 10) % 10
    return F.concat(body, last.cast("string"))


def _mod97(text: Column) -> Column:
    """What an IBAN, its first four characters put last and its letters as numbers from 10 on, leaves when divided by 97; 1 if it is valid."""
    bare = F.regexp_replace(text, " ", "")
    chars = F.filter(F.split(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban(country: Column, rest: Column) -> Column:
    """country and rest with the two check digits that make it valid between them."""
    return F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0"), rest)


def _kept_octets(ip: Column) -> Column:
    """How many first numbers of an address say that it is private, of the machine itself or of its link; 0 for a public one."""
    return F.when(ip.rlike(r"^(?:10|127)\."), 1).when(ip.rlike(r"^(?:192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."), 2).otherwise(0)


def _longer(attempt: Column) -> Column:
    return F.floor(attempt / GROWS).cast("int")


def _more(letters: str | list[str], stream: Column, attempt: Column) -> Column:
    n = _longer(attempt)
    return F.array_join(F.transform(F.slice(F.sequence(F.lit(1), n + 1), F.lit(1), n), lambda j: _one_of(letters, _number(stream, 128 - j))), "")


def _by_script(value: Column, made) -> Column:
    cyrillic = value.rlike(r"\p{IsCyrillic}$")
    return F.when(cyrillic, made("cyrillic")).otherwise(made("latin"))


def _as_spelled(value: Column, new: Column) -> Column:
    return F.when((F.length(value) > 1) & (value == F.upper(value)), F.upper(new)).when(value == F.lower(value), F.lower(new)).otherwise(new)


def _new_given(value: Column, stream: Column, attempt: Column, gender: Column) -> Column:
    of = F.coalesce(gender, F.when(_number(stream, F.lit(9)) % 2 == 0, "m").otherwise("f"))
    pick = lambda g, s: F.concat(_one_of(GIVEN[g, s], _number(stream, F.lit(0))), _more(SYLLABLES[s], stream, attempt))
    return _as_spelled(value, _by_script(value, lambda s: F.when(of == "m", pick("m", s)).otherwise(pick("f", s))))


def _new_family(value: Column, stream: Column, attempt: Column) -> Column:
    def made(script: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), 3 + _longer(attempt)), lambda j: _one_of(SYLLABLES[script], _number(stream, j))), "")

    new = _by_script(value, made)
    return _as_spelled(value, F.concat(F.upper(F.substring(new, 1, 1)), F.substr(new, F.lit(2))))


def surrogate(value: Column, kind: Column, attempt: Column, gender: Column, key: str) -> Column:
    """What replaces a part; of a mail address its local half."""

    def made(stream: Column) -> Column:
        top, code = F.substring_index(value, ".", -1), F.regexp_extract(value, _CODE, 1)
        head = F.when(kind == "token", F.regexp_extract(value, f"^({_TOKEN_HEADS}|)", 1)).when(kind == "iban", F.substring(value, 1, 4)).otherwise(F.regexp_extract(value, "^([0-9A-Fa-f]*:)", 1))
        inner = (
            F.when(kind == "email", F.substring_index(value, "@", 1))
            .when(kind == "domain", F.substr(value, F.lit(1), F.length(value) - F.length(top) - 1))
            .when(kind == "phone", F.substr(value, F.length(code) + 1))
            .when(kind.isin("token", "iban", "ipv6"), F.substr(value, F.length(head) + 1))
            .otherwise(value)
        )
        more = _more(LETTERS["[a-z]"], stream, attempt)
        octets = F.split(value, r"\.")  # a public address begins with 11 to 99, all of which are public
        new_octet = lambda x, i: F.when(i < _kept_octets(value), x).when(i == 0, (_number(stream, i) % 89 + 11).cast("string")).otherwise((_number(stream, i) % 254 + 1).cast("string"))
        octets = F.array_join(F.transform(octets, new_octet), ".")

        def whole(woven: Column) -> Column:
            return (
                F.when(kind == "email", F.concat(woven, more))
                .when(kind == "domain", F.concat(woven, more, F.lit("."), top))
                .when(kind == "ip", octets)
                .when(kind == "phone", F.concat(code, woven))
                .when(kind == "card", _card(woven))
                .when(kind == "token", F.concat(head, woven))
                .when(kind == "ipv6", F.concat(head, woven))
                .when(kind == "iban", _iban(F.substring(value, 1, 2), woven))
                .when(kind == "given", _new_given(value, stream, attempt, gender))
                .when(kind == "family", _new_family(value, stream, attempt))
                .otherwise(woven)
            )

        return bound(_hexadecimal(value, kind), lambda digits: bound(_woven(inner, stream, digits), whole))

    return bound(_stream(key, kind, identity(kind, value), attempt), made)


def _genders(found: DataFrame) -> DataFrame:
    """norm, gender of given names: what most of their titles say in all documents, null where they are even or say nothing."""
    names = found.where(F.col("e.kind") == "name").select(normal(_given(F.col("e.value"))).alias("norm"), _title(F.col("e.value")).alias("title")).where("norm <> ''")
    male, female = F.col("title").rlike("^(Mr|Herr|Monsieur|Señor|Господин)[. ]"), F.col("title").rlike("^(Mrs|Ms|Miss|Frau|Mme|Madame|Señora|Госпожа)[. ]")
    lead = F.count_if(male) - F.count_if(female)
    return names.groupBy("norm").agg(lead.alias("lead")).select(F.lit("given").alias("kind"), "norm", F.when(F.col("lead") > 0, "m").when(F.col("lead") < 0, "f").alias("gender"))


def _resolved(values: DataFrame, key: str, tries: int = MOST_TRIES) -> DataFrame:
    """kind, norm, attempt of the distinct values (kind, norm, value, gender) that need an attempt after the first."""

    def attempted(df: DataFrame) -> DataFrame:
        new = surrogate(F.col("value"), F.col("kind"), F.col("attempt"), F.col("gender"), key)
        whole = F.when(F.col("kind") == "email", F.concat(new, F.lit("@"), _domain(F.col("value")))).otherwise(new)
        return df.withColumn("made", identity(F.col("kind"), whole))

    spelled = settled(values.select("kind", "norm", "value", "gender").distinct())
    real = settled(spelled.select("kind", F.col("norm").alias("made")).distinct())
    now = settled(attempted(spelled.withColumn("attempt", F.lit(0))))
    for _ in range(tries):
        shared = now.groupBy("kind", "made").agg(F.min("norm").alias("least"), F.max("norm").alias("most"), F.min(F.struct("attempt", "norm")).alias("first")).where("least <> most")
        later = now.join(shared, ["kind", "made"]).where(F.col("norm") != F.col("first.norm")).select("kind", "norm")
        leaking = now.join(real, ["kind", "made"], "left_semi").select("kind", "norm")
        bad = settled(later.unionByName(leaking).distinct())
        if bad.isEmpty():
            return now.where("attempt > 0").select("kind", "norm", "attempt").distinct()
        again = now.join(bad, ["kind", "norm"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        now = settled(now.join(bad, ["kind", "norm"], "left_anti").unionByName(attempted(again.drop("made"))))
    raise ValueError(f"{bad.count()} values have no surrogate of their own after {tries} attempts")


def _entities(text: Column, pattern: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))


def _mentions(found: Column) -> Column:
    """The pattern of a document: _ANY, and its persons without their titles."""
    titled = F.filter(found, lambda e: (e["kind"] == "name") & (_title(e["value"]) != ""))
    bare = F.transform(titled, lambda e: F.substr(e["value"], F.length(_title(e["value"])) + 1))
    full = F.filter(bare, lambda n: F.contains(n, F.lit(" ")))
    named = F.concat(full, F.transform(bare, _family))
    named = F.array_distinct(F.concat(named, F.transform(named, F.upper), F.transform(full, F.lower)))
    quoted = F.array_join(F.transform(named, lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E"))), "|")
    return F.when(F.size(named) > 0, F.concat(F.lit(_ANY + r"|(?<!\p{L})(?:"), quoted, F.lit(r")(?!\p{L})"))).otherwise(F.lit(_ANY))


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """docs' columns, the text rewritten, with n_<kind> counts."""
    row = row_key("doc_id", "text")
    plain = docs.where(F.col("text").rlike(_CHEAP)).select(row.alias("row"), "text", _entities(F.col("text"), F.lit(_ANY)).alias("found"))
    listed = plain.where(F.size("found") > 0).withColumn("pattern", _mentions(F.col("found")))
    again = F.when(F.col("pattern") != _ANY, _entities(F.col("text"), F.col("pattern"))).otherwise(F.col("found"))
    listed = listed.select("row", "pattern", again.alias("found")).where(F.exists("found", lambda e: e["kind"].isNotNull()))
    listed = settled(listed.dropDuplicates(["row"]))

    found = settled(listed.select("row", F.explode(F.array_distinct("found")).alias("e")).where("e.kind IS NOT NULL"))
    pieces = found.select("row", F.explode(parts(F.col("e"))).alias("p")).select("row", "p.*").withColumn("norm", identity(F.col("kind"), F.col("value"))).distinct()
    pieces = settled(pieces.join(hinted(settled(_genders(found))), ["kind", "norm"], "left"))
    later = settled(_resolved(pieces, key))
    # What a document must know of its parts: later attempts, and the genders of given names.
    known = pieces.join(hinted(later), ["kind", "norm"], "left").where("attempt IS NOT NULL OR gender IS NOT NULL")
    known = known.select("row", F.concat_ws("|", "kind", "norm").alias("name"), F.struct(F.coalesce("attempt", F.lit(0)).alias("attempt"), "gender").alias("how")).distinct()
    known = known.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("name", "how"))).alias("known"))
    listed = settled(listed.join(hinted(settled(known)), "row", "left"))

    def rewritten(e: Column) -> Column:
        def new(part: Column) -> Column:
            how = F.col("known")[F.concat_ws("|", part["kind"], identity(part["kind"], part["value"]))]
            return surrogate(part["value"], part["kind"], F.coalesce(how["attempt"], F.lit(0)), how["gender"], key)

        def joined(own: Column) -> Column:
            return F.when(e["kind"] == "email", F.array_join(own, "@")).when(e["kind"] == "name", F.concat(_title(e["value"]), F.array_join(own, " "))).otherwise(own[0])

        return F.when(e["kind"].isNull(), e["value"]).otherwise(bound(F.transform(parts(e), new), joined))

    counts = [f"n_{k}" for k in KINDS]
    base = docs.select(kept_columns(docs, *counts).alias("own"), row.alias("row"))
    few = hinted(settled(listed.select("row")))
    whole = base.join(few, "row", "left_anti").select("own", *[F.lit(0).alias(c) for c in counts])
    touched = base.join(few, "row", "left_semi").join(listed, "row")
    gaps = F.split("own.text", F.col("pattern"))
    filled = F.concat(F.transform("found", rewritten), F.array(F.lit("")))
    text = F.array_join(F.zip_with(gaps, filled, lambda g, e: F.concat(g, e)), "")
    kinds = F.transform("found", lambda e: e["kind"])
    held = [F.size(F.filter(kinds, F.lit(kind).__eq__)).alias(c) for kind, c in zip(KINDS, counts)]
    touched = touched.select(F.col("own").withField("text", text).alias("own"), *held)
    return whole.unionByName(touched).select("own.*", *counts)
