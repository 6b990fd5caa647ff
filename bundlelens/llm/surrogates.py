"""Personal data replaced by surrogates, in DataFrame functions only.

Entities are found by one pattern and brought to a normal form: digits of a number, lower-case address, single words of a name.
Each different normal form gets one surrogate in the whole corpus, derived from a key, so the same entity is the same everywhere,
however it is written, and cannot be led back without the key. Each mention is rendered in its own format: digits stay digits, letters keep
case and script, marks stay; cards and accounts get valid check digits; given names show the gender of their title. Words of a titled name are replaced wherever
they stand in that document, with or without a title. A surrogate that another entity has too, or that occurs as an entity itself, is derived anew until all are distinct.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.common import documents, hold

TITLES = {"m": ["Mr", "Sir", "Herrn?", "Señor", "Sr", "Monsieur", r"M\.", "Господин", "Κύριος"],
          "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Srta", "Madame", "Mme", "Mademoiselle", "Mlle", "Госпожа", "Κυρία"],
          "n": ["Dr", "Doctor", "Doktor", "Prof", "Professor", "Profesora?", "Doctora"]}
#: Given names by script and gender, and syllables of last names by script.
GIVEN = {"m": ["Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Lucas", "Martin", "Oscar", "Paul", "Simon", "Thomas", "Victor"],
         "f": ["Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Irene", "Julia", "Laura", "Marta", "Nora", "Olga", "Paula", "Rosa", "Vera"]}
CYRILLIC = {"m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Игорь", "Олег", "Павел"], "f": ["Алла", "Вера", "Галина", "Дарья", "Елена", "Инна", "Ольга", "Полина"]}
GREEK = {"m": ["Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"], "f": ["Άννα", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Σοφία"]}
SYLLABLES = {"latin": [c + v for c in "bdfklmnrst" for v in "aeiou"], "cyrillic": [c + v for c in "бвдзклмнрт" for v in "аеиоу"],
             "greek": [c + v for c in "βδκλμνπρστ" for v in "αειου"]}
#: Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|^0"
WORD = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]{1,40}+(?:[-'’]\p{Lu}[\p{L}\p{M}]{1,40}+){0,3}(?![\w\p{L}])"
_PARTS = "(?:(?:van|von|zu|de|der|den|dos|da|del|della|di|du|la|le|ter|bin|al|el) ){0,3}"
#: What secrets of known services begin with; it stays.
PREFIX = r"(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|sk-|xox[abprs]-)"
_ANY = "[A-Za-z0-9+/]"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Each kind of entity as a pattern; the first that fits counts.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}",
    "secret": r"(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)(?![\w])",
    # A known prefix, or 32 characters and more with digits and letters of both cases.
    "key": rf"(?:{PREFIX}[A-Za-z0-9_-]{{16,255}}+|(?={_ANY}{{32}})(?={_ANY}{{0,127}}[0-9])(?={_ANY}{{0,127}}[A-Z])(?={_ANY}{{0,127}}[a-z]){_ANY}{{32,128}}+={{0,2}})(?![\w])",
    "ipv6": rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\w:])",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w])",
    "card": r"(?:3[47]\d{2}[ -]\d{6}[ -]\d{5}|\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7})(?![\w])",
    "iban": r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\w])",
    "national": r"\d{3}-\d{2}-\d{4}(?![\w])",
    # 3-3-4 digits; any grouping after a country code; France, Germany and Spain without one.
    "phone": r"(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+(?=(?:[ .()-]{0,2}\d){8})\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,9})){1,5}"
             r"|0\d(?:[ .-]\d{2}){4}|0\d{2,4}[ /-]\d{5,8}|[6-9]\d{2}(?: \d{2}){3})(?![\w])",
    "name": "(?:" + "|".join(t for g in TITLES.values() for t in g) + rf")\.? {_PARTS}{WORD}(?: {_PARTS}{WORD}){{0,2}}",
}
_START = r"(?<![\w\p{L}.%@-])(?:"
PATTERN = _START + "|".join(KINDS.values()) + ")"
#: The same with single words in place of titled names.
WORDS = _START + "|".join([*(v for k, v in KINDS.items() if k != "name"), WORD]) + ")"
DIGITS = ("card", "iban", "national", "phone")


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(KINDS.items()):
        if kind != "name":
            out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def normal(value: Column, kind: Column) -> Column:
    """What all mentions of an entity have in common."""
    return (F.when(kind.isin("card", "national"), F.regexp_replace(value, "[^0-9]", "")).when(kind == "phone", F.regexp_replace(value, "[^0-9+]", ""))
            .when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).when(kind.isin("ip", "key"), value).otherwise(F.lower(value)))


def rendered(value: Column, kind: Column, new: Column) -> Column:
    """A surrogate of a normal form in the format and case of one mention."""
    of = lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(new, i, F.lit(1)))).otherwise(F.substring(new, i, F.lit(1)))
    before = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^A-Za-z0-9+]", ""))
    spread = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[A-Za-z0-9+]"), of(c, before(i))).otherwise(c)), "")
    cased = F.array_join(F.transform(F.split(value, ""), lambda c, i: of(c, i + 1)), "")
    return (F.when(kind.isin(*DIGITS), spread).when(kind == "email", cased).when(kind.isin("ipv6", "secret") & value.rlike("[A-F]"), F.upper(new))
            .when((kind == "name") & (value == F.upper(value)), F.upper(new)).otherwise(new))


def checked_card(value: Column) -> Column:
    """The last digit set so that the digit sum of the rule for cards is a multiple of ten."""
    back = F.reverse(F.substring(value, F.lit(1), F.length(value) - 1))
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.transform(F.split(back, ""), lambda c, i: F.when(i % 2 == 0, twice(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)
    return F.concat(F.substring(value, F.lit(1), F.length(value) - 1), F.pmod(-total, F.lit(10)).cast("string"))


def checked_iban(value: Column) -> Column:
    """The check digits set so that the account, country last, is 1 modulo 97."""
    country, rest = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))
    left = F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), step)
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def substituted(value: Column, digest: Column) -> Column:
    """Digits by digits and letters A-Z by letters of the same case, each from two hex digits of the digest in turn; all else stays."""
    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(digest, F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 63).cast("int")
        return (F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
                .when(c.rlike("[a-z]"), F.char(F.pmod(n, F.lit(26)) + 97)).when(c.rlike("[A-Z]"), F.char(F.pmod(n, F.lit(26)) + 65)).otherwise(c))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def name_word(value: Column, kind: Column, digest: Column, turn: Column) -> Column:
    """A given name by gender, or a last name of syllables, in the script of the word; later turns have a syllable more, so names never run out."""
    number = lambda at: F.conv(F.substring(digest, at, 6), 16, 10).cast("int")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), F.pmod(number(at), F.lit(len(xs))) + 1)

    def of(script: str, given: dict) -> Column:
        more = lambda lo, n: F.concat(*(F.when(n > k, pick(SYLLABLES[script], lo + 6 * k)).otherwise("") for k in range(6)))
        last = F.concat(F.initcap(more(9, F.least(3 + F.floor(turn / 2), F.lit(6)))),
                        F.when(value.contains("-"), F.concat(F.lit("-"), F.initcap(more(50, F.lit(3))))).otherwise(""))
        last = F.concat(F.upper(F.regexp_extract(value, "^\\p{L}['’]", 0)), last)
        first = F.when(kind == "given f", pick(given["f"], 1)).when(kind == "given m", pick(given["m"], 1)).otherwise(pick(given["m"] + given["f"], 1))
        return F.when(kind == "last", last).otherwise(F.concat(first, more(9, F.least(turn, F.lit(6)))))

    return (F.when(value.rlike("\\p{IsCyrillic}"), of("cyrillic", CYRILLIC)).when(value.rlike("\\p{IsGreek}"), of("greek", GREEK)).otherwise(of("latin", GIVEN)))


def surrogate(value: Column, kind: Column, digest: Column, turn: Column) -> Column:
    """A normal form of the same kind and length."""
    number = lambda at: F.conv(F.substring(digest, at, 6), 16, 10).cast("int")
    at = F.instr(value, "@")
    # The mail name and the leading label change, what follows the first dot of the host stays.
    host = F.substring(value, at + 1, F.length(value))
    email = F.concat(substituted(F.substring(value, F.lit(1), at), digest), substituted(F.substring_index(host, ".", 1), F.reverse(digest)),
                     F.substring(host, F.length(F.substring_index(host, ".", 1)) + 1, F.length(host)))
    ip = F.concat_ws(".", F.lit("10"), *((F.pmod(number(1 + 8 * i), F.lit(254)) + 1).cast("string") for i in range(3)))
    hexed = F.concat(F.substring(digest, F.lit(1), F.length(value)), F.substring(F.sha2(digest, 512), F.lit(1), F.greatest(F.lit(0), F.length(value) - 128)))
    ipv6 = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(digest, i + 1, F.lit(1)))), "")
    # The leading digit of a card, a key's prefix and the country code of a phone number or account are no secrets and keep the format valid.
    head = F.when(kind == "card", F.substring(value, 1, 1)).when(kind == "iban", F.substring(value, 1, 2)).when(
        kind == "key", F.regexp_extract(value, "^" + PREFIX, 0)).when(kind == "phone", F.regexp_extract(value, COUNTRY, 0)).otherwise("")
    other = F.concat(head, substituted(F.substring(value, F.length(head) + 1, F.length(value)), digest))
    other = F.when(kind == "card", checked_card(other)).when(kind == "iban", checked_iban(other)).otherwise(other)
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "secret", hexed)
            .when(kind.rlike("^(?:last|given)"), name_word(value, kind, digest, turn)).otherwise(other))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``value``, ``kind``, ``surrogate`` for each different ``value`` and ``kind``; surrogates are distinct and none is itself a value.

    Each pass derives those in conflict again with the next number; of entities with the same surrogate the least keeps it. The number of
    passes is small as the chance of a conflict falls with each; domains too small for their entities (more network addresses than exist) fail after 50.
    """
    todo = hold(entities.select("value", "kind").withColumn("turn", F.lit(0)))
    real = todo.select(F.lower("value").alias("low")).distinct().withColumn("is_real", F.lit(True))
    for _ in range(50):
        digest = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "value", F.col("turn").cast("string")), 512)
        made = hold(todo.withColumn("surrogate", surrogate(F.col("value"), F.col("kind"), digest, F.col("turn"))).withColumn("low", F.lower("surrogate")))
        owner = made.groupBy("low").agg(F.min(F.struct("value", "kind")).alias("owner"))
        judged = made.join(owner, "low").join(real, "low", "left")
        clash = (F.struct("value", "kind") != F.col("owner")) | F.col("is_real").isNotNull()
        if judged.filter(clash).isEmpty():
            return made.select("value", "kind", "surrogate")
        todo = hold(judged.select("value", "kind", (F.col("turn") + F.when(clash, 1).otherwise(0)).alias("turn")))
    raise ValueError("too many entities for distinct surrogates of their format")


def name_words(names: DataFrame) -> DataFrame:
    """``i``, ``t``, ``word`` (lower case) and ``part`` (last, or given with gender) of the documents' titled names; a word that is both counts as last."""
    words = F.regexp_extract_all(F.regexp_replace("value", "^[^ ]+ ", ""), F.lit(f"({WORD})"), F.lit(1))
    title = lambda g: F.col("value").rlike("^(?:" + "|".join(TITLES[g]) + r")\.? ")
    given = F.when(title("f"), "given f").when(title("m"), "given m").otherwise("given n")
    each = names.select("id", "th", given.alias("given"), words.alias("words"))
    each = each.select("id", "th", "given", F.size("words").alias("n"), F.posexplode("words").alias("k", "word"))
    part = F.when(F.col("k") == F.col("n") - 1, "last").otherwise(F.col("given"))
    return each.groupBy(F.col("id").alias("i"), F.col("th").alias("t"), F.lower("word").alias("word")).agg(F.max(part).alias("part"))


def replace(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id``, ``th``, ``text`` with surrogates, ``n_entities`` (replaced mentions; each word of a name is one) and ``kinds`` (sorted, distinct).

    Null text is empty; a text without entities is unchanged; equal rows get equal texts; an empty table gives no rows. Mentions of one normal form get
    one surrogate. Entities that are very common are split by the join, not gathered.
    """
    docs = documents(df, id_col, text_col)
    some = docs.select("id", "th", "text", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found")).filter(F.size("found") > 0)
    titled = F.col("value").rlike("^(?:" + KINDS["name"] + ")$")
    some = hold(some.dropDuplicates(["id", "th"]).withColumn("named", F.exists("found", lambda value: value.rlike("^(?:" + KINDS["name"] + ")$"))))
    words = hold(name_words(some.filter("named").select("id", "th", F.explode("found").alias("value")).filter(titled)))
    found = F.when(F.col("named"), F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).otherwise(F.col("found"))
    mentions = some.select("id", "th", F.posexplode(found).alias("k", "value")).withColumn("kind", kind_of(F.col("value")))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))
    mentions = mentions.join(words, same & (F.col("kind") == "name") & (F.lower("value") == F.col("word")), "left").select(
        "id", "th", "k", "value", F.when(F.col("kind") != "name", F.col("kind")).otherwise(F.col("part")).alias("entity"),
        F.when((F.col("kind") != "name") | F.col("part").isNotNull(), F.col("kind")).alias("kind"), normal(F.col("value"), F.col("kind")).alias("norm"))
    mentions = hold(mentions)
    known = assign(mentions.filter("entity is not null").select(F.col("norm").alias("value"), F.col("entity").alias("kind")).distinct(), key)
    known = known.select(F.col("value").alias("norm"), F.col("kind").alias("entity"), "surrogate")
    new = F.coalesce(rendered(F.col("value"), F.col("kind"), F.col("surrogate")), F.col("value"))
    placed = mentions.join(known, ["norm", "entity"], "left").groupBy(F.col("id").alias("i"), F.col("th").alias("t")).agg(
        F.array_sort(F.collect_list(F.struct("k", new.alias("surrogate"), "kind"))).alias("found"))
    placed = placed.join(some.select("id", "th", "named"), same).drop("id", "th")
    out = docs.join(placed, same, "left")
    parts = F.when(F.col("named"), F.split("text", WORDS)).otherwise(F.split("text", PATTERN))
    text = F.array_join(F.zip_with(parts, F.concat(F.col("found.surrogate"), F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    kinds = F.filter("found.kind", lambda x: x.isNotNull())
    return out.select("id", "th", F.when(F.col("found").isNull(), F.col("text")).otherwise(text).alias("text"),
                      F.when(F.col("found").isNull(), 0).otherwise(F.size(kinds)).cast("long").alias("n_entities"),
                      F.coalesce(F.array_sort(F.array_distinct(kinds)), F.array().cast("array<string>")).alias("kinds"))
